"""The engine's tables.  Ids are lower-case hex text, whose order is that of the bytes."""

#: One row for each operation.
NODES = "doc_id long, node_id string, op string, anchor string, ch string, extra_deps array<string>, targets array<string>"
#: The compact log: a run holds a chain of characters, each inserted after the one before.  ``targets`` are ids of 32 bytes each, one after
#: the other in their order; ``places`` say in which records, and at which characters, the anchor or the targets stand.
RECORDS = "doc_id long, seq long, rec_id string, kind string, anchor string, text string, extra_deps array<string>, targets binary, places array<struct<rec: string, lo: long, hi: long>>"
#: Positional edits: at ``pos`` delete ``del`` characters, then insert ``ins``; in (txn, i) order.
PATCHES = "doc_id long, txn long, i long, pos long, del long, ins string"
#: A trace file: the final text and transactions of [position, deleted, inserted] patches.
TRACE = "endContent string, txns array<struct<patches: array<array<string>>>>"
FORMAT_VERSION = 1
