"""The row of a chain and what its fields may hold."""

from __future__ import annotations

BLOCKS = "array<struct<size:bigint,gap_reference:bigint,gap_query:bigint>>"
ABSOLUTE = "array<struct<r_start:bigint,r_end:bigint,q_start:bigint,q_end:bigint>>"
HEADER = ["score", "r_name", "r_size", "r_strand", "r_start", "r_end", "q_name", "q_size", "q_strand", "q_start", "q_end", "id"]
#: Coordinates are unsigned 32-bit and ids unsigned 64-bit; both exceed the signed types of that width.
MAX_U32, MAX_U64 = 4_294_967_295, 18_446_744_073_709_551_615
CHAINS = (
    "file_no int, offset bigint, score bigint, r_name string, r_size bigint, r_strand string, r_start bigint, r_end bigint, "
    f"q_name string, q_size bigint, q_strand string, q_start bigint, q_end bigint, id decimal(20,0), id_explicit boolean, blocks {BLOCKS}"
)
ITEMS = f"kind string, {CHAINS}, length bigint, line string, error string, error_offset bigint"
