"""Schemas of the relations, as Spark DDL."""

ENTRY = "struct<blob_hash: string, size: bigint, mode: int>"
TREE_OP = f"struct<op: string, path: string, entry: {ENTRY}>"
RECORDS = "id bigint, branch bigint, sequence bigint, ts timestamp, record_type string, payload binary, encoding string, caused_by array<bigint>, linked_to array<bigint>, kind string"
STATE_OPS = f"record_id bigint, branch bigint, sequence bigint, ts timestamp, state_id string, op string, value string, idx bigint, idx_end bigint, path string, entry {ENTRY}, ops array<{TREE_OP}>, field_path array<string>, derived boolean"
BRANCHES = "id bigint, name string, parent bigint, branch_point bigint, created timestamp, deleted boolean, state_parent bigint, inherits_state boolean"
STATE_SLOTS = "state_id string, strategy string, d bigint, f bigint, fields string"
BLOBS = "hash string, shard string, content binary, content_type string, size bigint, crc32 bigint"
RELATIONS = {"records": RECORDS, "state_ops": STATE_OPS, "branches": BRANCHES, "state_slots": STATE_SLOTS, "blobs": BLOBS}
