"""The engine's scalar functions for spark.sql: temporary functions whose bodies Catalyst puts in place, without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from alignloom.functions import bases, gaps
from alignloom.schema import BLOCKS

_SIDES = [f"{p}_{f} {t}" for p in "rq" for f, t in (("name", "STRING"), ("size", "BIGINT"), ("strand", "STRING"), ("start", "BIGINT"), ("end", "BIGINT"))]
_FIELDS = ["score BIGINT", *_SIDES, "id DECIMAL(20,0)"]
_LINE = "CASE WHEN i + 1 < size(chain_blocks) THEN concat_ws('\\t', b.size, b.gap_reference, b.gap_query) ELSE CAST(b.size AS STRING) END"
_HEADER = f"concat_ws(' ', 'chain', {', '.join(f.split()[0] for f in _FIELDS)})"


def definitions() -> dict[str, str]:
    """Name -> parameters, result and body.

    gap_cost(dq, dt) and gap_cost_<table>(dq, dt); reverse_complement(bases);
    chain_header(score, ..., id): a chain's header line; chain_blocks_text(blocks): its
    block lines; chain_record(score, ..., id, blocks): both and the blank line's newline.
    """
    out = {f"gap_cost_{name.lower()}": f"(dq BIGINT, dt BIGINT) RETURNS BIGINT RETURN {gaps.cost_sql('dq', 'dt', name)}" for name in gaps.TABLES}
    out["gap_cost"] = out["gap_cost_loose"]
    out["reverse_complement"] = f"(bases STRING) RETURNS STRING RETURN reverse(translate(bases, '{bases.BASES}', '{bases.COMPLEMENTS}'))"
    out["chain_header"] = f"({', '.join(_FIELDS)}) RETURNS STRING RETURN {_HEADER}"
    blocks = f"array_join(transform(chain_blocks, (b, i) -> {_LINE}), '\\n')"
    out["chain_blocks_text"] = f"(chain_blocks {BLOCKS}) RETURNS STRING RETURN {blocks}"
    out["chain_record"] = f"({', '.join(_FIELDS)}, chain_blocks {BLOCKS}) RETURNS STRING RETURN concat({_HEADER}, '\\n', {blocks}, '\\n')"
    return out


def register(spark: SparkSession) -> None:
    """Makes definitions() known to the session."""
    for name, definition in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
