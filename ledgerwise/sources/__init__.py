"""Reading and writing: statement files, document payloads, tables."""
