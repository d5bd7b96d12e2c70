"""Schemas of the tables that make up a pack, as DDL."""

FILES = "file string not null, content string"
FINDING = "struct<reason:string,line:int,matched_text:string>"
FEATURES = "signatures array<string>, dependencies array<string>, api array<string>, compressed string"
EDGES = "src string, dst string, kind string, ord int"
STACK = "manifest string, language string, package_manager string, dependencies array<string>, dependencies_truncated boolean"
#: A pack is these tables in one folder.
TABLES = {
    "files": "file string, ord int, summary string, confidence double",
    "detail": "file string, compressed string",
    "manifest": "file string, sha256 string",
    "edges": EDGES,
    "project": f"name string, prompt string, rules array<string>, tech_stack array<struct<{STACK.replace(' array<string>', ':array<string>').replace(' string', ':string').replace(' boolean', ':boolean')}>>",
    "tokens": "model string, original bigint, compressed bigint, saved_pct double",
}
