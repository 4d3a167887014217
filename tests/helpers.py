"""Helpers of the tests."""


def make_lines(spark, files: dict):
    """Numbered non-blank lines of in-memory texts."""
    rows = []
    for fid, text in files.items():
        kept = [ln for ln in text.split("\n") if ln.strip()]
        rows += [(fid, i, ln, len(kept)) for i, ln in enumerate(kept, 1)]
    return spark.createDataFrame(rows, "file_id long, line_no long, raw string, n_lines long")
