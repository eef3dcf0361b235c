"""Types of the nested inputs."""

ENTRY_FIELDS = (
    "name", "initials", "name_prefix", "name_prefix_expanded", "occupation", "occupation_expanded", "address_street",
    "address_street_expanded", "address_number", "address_full", "phone", "entity_type", "role", "parent_organization", "description", "notes",
)
_ENTRY = ", ".join(f"{f}: string" for f in ENTRY_FIELDS) + ", word_ids: array<string>, name_word_ids: array<string>, address_word_ids: array<string>, entry_bbox: array<int>, name_bbox: array<int>, address_bbox: array<int>, cross_references: array<struct<type: string, page: int, text: string, page_number: int>>"
ENTRY = f"struct<{_ENTRY}>"
PAGE = (
    "page_number int, section string, scan_file string, dimensions struct<width: int, height: int>, "
    f"entries array<{ENTRY}>, streets array<struct<street_name: string, street_name_expanded: string, entries: array<{ENTRY}>>>, "
    f"occupations array<struct<occupation_name: string, occupation_name_expanded: string, entries: array<{ENTRY}>>>, "
    f"entities array<{ENTRY}>, advertisements array<struct<business_name: string, {_ENTRY}>>, "
    "addresses_found array<struct<context: string, address_street: string, address_street_expanded: string, address_number: string, address_word_ids: array<string>>>"
)
WORD = "struct<id: string, text: string, bbox: array<int>, confidence: int, line_id: string>"
OCR = f"scan_file string, width int, height int, schema_version int, blocks array<struct<id: string, bbox: array<int>, lines: array<struct<id: string, bbox: array<int>, words: array<{WORD}>>>>>"
OVERRIDE = "struct<fields: map<string,string>, flags: map<string,boolean>, bbox: struct<type: string, value: array<int>, source: string>, fingerprint: string, edited_at: string>"
GEOCODE = "struct<status: string, query: string, lat: double, lng: double, score: double, matched: string, type: string, flags: array<string>>"
MATCH = "struct<addresses: map<string, struct<lat: double, lng: double, raw: string, entries: array<string>, approx: boolean>>>"
