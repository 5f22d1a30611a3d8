"""Tables shared by the tests of the log-mining core."""

SF_SMALL = "/root/testdata/sf0.001"


def lines_df(spark, lines, start=0, block_bits=2):
    """Raw log rows (seq, block, value) from Python strings, in tiny blocks."""
    rows = [(start + i, (start + i) >> block_bits, v) for i, v in enumerate(lines)]
    return spark.createDataFrame(rows, "seq bigint, block bigint, value string")


def final_part(plan: str) -> str:
    """An adaptive plan without its initial plans (that of each subquery neither)."""
    kept, skipped = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :"))
        if skipped is not None and depth >= skipped:
            continue
        skipped = depth if "== Initial Plan ==" in line else None
        if skipped is None:
            kept.append(line)
    return "\n".join(kept)
