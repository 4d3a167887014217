"""Tier-1 detection over many files at once.

Input everywhere is ``lines(file_id, line_no, raw, n_lines)``: non-blank
lines numbered from 1 per file (``seamfix.sources.lines`` or the rendered
driver tables). Plan shape:

1. ``shape_groups``: ONE scan of the lines, 5 candidate delimiters per line
   via ``inline``, partial hash aggregation to (file, candidate, occurrences,
   field count) groups. The shuffle carries a handful of rows per file.
2. Everything per file (vote, tail vote, header offset, single column,
   width of line 1) is derived from those small groups.
3. Line-level follow-ups (garbled header, numeric columns, mixed rows)
   join the per-file decisions back to the lines; the decision frame has
   one row per file, so it is broadcast behind the file-count bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamfix import constants as K
from seamfix.functions import text as T
from seamfix.plans.joins import sized_broadcast
from seamfix.session import cut_lineage

_PREF = {d: i for i, d in enumerate(K.DELIMITER_PREFERENCE)}
_WORD = 63  # column positions per bitmask word (sign bit unused)
_SENTINEL = "\ue000"  # private-use character marking split points
_ESCAPE = "\ue001"  # escapes the sentinel in the rare line that holds it


# ---------------------------------------------------------------- D3, D4, D6
def shape_groups(lines: DataFrame) -> DataFrame:
    """(file_id, cand, pref, occ, fc) -> cnt, cnt_tail, min_ln, max_ln.

    Lines are first aggregated by their whole shape (occurrences and field
    count under all five candidates): the lines of a regular file share a
    handful of shapes, so the partial aggregate collapses them before any
    row is multiplied. Only the aggregated shapes are split per candidate
    and re-aggregated (sum, min, max compose exactly)."""
    tail = F.col("line_no") > F.col("n_lines") - K.SNIFF_TAIL_LINES
    n = len(K.CANDIDATE_DELIMITERS)
    # Occurrences outside quoted fields (the vote), then field counts from
    # them in a second projection: the optimizer keeps the two apart rather
    # than evaluate every count twice.
    quoted = F.instr("raw", '"') > 0
    counted = lines.select(
        "file_id", "line_no", "raw", tail.alias("is_tail"), quoted.alias("_q"),
        F.when(quoted, T.blank_any_quoted(F.col("raw"))).otherwise(F.col("raw")).alias("_b"))
    counted = counted.select(
        "file_id", "line_no", "raw", "is_tail", "_q",
        *[T.occurrences(F.col("_b"), d).cast("long").alias(f"_o{i}") for i, d in enumerate(K.CANDIDATE_DELIMITERS)])
    field_counts = [
        F.when(F.col("_q"), T.occurrences(T.blank_quoted(F.col("raw"), d), d) + 1)
        .otherwise(F.col(f"_o{i}") + 1).cast("long").alias(f"_f{i}")
        for i, d in enumerate(K.CANDIDATE_DELIMITERS)]
    keys = [c for i in range(n) for c in (f"_o{i}", f"_f{i}")]
    shaped = counted.select("file_id", "line_no", "is_tail", *[f"_o{i}" for i in range(n)], *field_counts)
    shapes = shaped.groupBy("file_id", *keys).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count_if("is_tail").alias("cnt_tail"),
        F.min("line_no").alias("min_ln"),
        F.max("line_no").alias("max_ln"),
    )
    per_cand = F.array(*[
        F.struct(F.lit(d).alias("cand"), F.lit(_PREF[d]).alias("pref"),
                 F.col(f"_o{i}").alias("occ"), F.col(f"_f{i}").alias("fc"))
        for i, d in enumerate(K.CANDIDATE_DELIMITERS)
    ])
    split = shapes.select("file_id", "cnt", "cnt_tail", "min_ln", "max_ln", F.inline(per_cand))
    return split.groupBy("file_id", "cand", "pref", "occ", "fc").agg(
        F.sum("cnt").alias("cnt"),
        F.sum("cnt_tail").alias("cnt_tail"),
        F.min("min_ln").alias("min_ln"),
        F.max("max_ln").alias("max_ln"),
    )


def _pick(n: str, m: str, occ: str) -> Column:
    """Vote (A.1) as one conditional ``max_by``: a candidate counts when its
    most frequent per-line count is > 0 and (2m - n)/n >= 0.9; the highest
    share level wins, then preference. Null when no candidate qualifies."""
    ok = (F.col(occ) > 0) & ((2 * F.col(m) - F.col(n)) * 10 >= 9 * F.col(n))
    level = F.floor((2 * F.col(m) - F.col(n)) * 100 / F.col(n))
    return F.max_by("cand", F.when(ok, F.struct(level, -F.col("pref"))))


def delimiter_vote(groups: DataFrame) -> DataFrame:
    """file_id, n_lines, whole_delim, tail_delim, delimiter."""
    by_occ = groups.groupBy("file_id", "cand", "pref", "occ").agg(
        F.sum("cnt").alias("cnt"), F.sum("cnt_tail").alias("cnt_tail")
    )
    per = by_occ.groupBy("file_id", "cand", "pref").agg(
        F.sum("cnt").alias("n"),
        F.max(F.struct("cnt", "occ")).alias("mw"),
        F.sum("cnt_tail").alias("nt"),
        F.max(F.struct("cnt_tail", "occ")).alias("mt"),
    ).select("file_id", "cand", "pref", "n", "nt",
             F.col("mw.cnt").alias("m"), F.col("mw.occ").alias("mocc"),
             F.col("mt.cnt_tail").alias("mtc"), F.col("mt.occ").alias("mtocc"))
    return per.groupBy("file_id").agg(
        F.max("n").alias("n_lines"),
        _pick("n", "m", "mocc").alias("whole_delim"),
        _pick("nt", "mtc", "mtocc").alias("tail_delim"),
    ).withColumn("delimiter", F.coalesce("whole_delim", "tail_delim", F.lit(K.DEFAULT_DELIMITER)))


# ------------------------------------------------------- D5, D7, D8 (per file)
def structure(lines: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Per file: delimiter, n_lines, single_column, w1 (width of line 1),
    width (w of the consistent tail), offset (D8, null when none)."""
    groups = groups if groups is not None else shape_groups(lines)
    # One hash partitioning by file, then nothing but file-local work: the
    # width statistics are taken for every candidate (at most five per
    # file), so the chosen one is picked after the vote with an array
    # filter instead of a join on (file, candidate) that would re-shuffle.
    # The one join is on file_id alone between two frames already hash
    # partitioned by it (hinted merge join: AQE would otherwise make it a
    # broadcast, a job of its own). AQE may coalesce the partitions, as
    # the frame holds a few rows per file.
    groups = groups.repartition("file_id")
    vote = delimiter_vote(groups)
    by_fc = groups.groupBy("file_id", "cand", "fc").agg(
        F.min("min_ln").alias("min_ln"), F.max("max_ln").alias("max_ln"))
    # ends: last line of each width group, sorted; bounded by the number of
    # distinct widths in a file, not by its lines.
    per_cand = by_fc.groupBy("file_id", "cand").agg(
        F.max("fc").alias("max_fc"),
        F.max("max_ln").alias("last_ln"),
        F.max_by("fc", "max_ln").alias("width"),
        F.max_by("min_ln", "max_ln").alias("gmin"),
        F.min_by("fc", "min_ln").alias("w1"),
        F.count(F.lit(1)).alias("n_widths"),
        F.array_sort(F.collect_list("max_ln")).alias("ends"),
    )
    stats = per_cand.groupBy("file_id").agg(F.collect_list(F.struct(
        "cand", "max_fc", "last_ln", "width", "gmin", "w1", "n_widths", "ends")).alias("_cs"))
    chosen = F.element_at(F.filter("_cs", lambda x: x["cand"] == F.col("delimiter")), 1)
    per = vote.join(stats.hint("shuffle_merge"), "file_id").withColumn("_s", chosen)
    out = per.select("file_id", "n_lines", "whole_delim", "tail_delim", "delimiter", "_s.*").drop("cand")
    m2 = F.when(F.size("ends") >= 2, F.element_at("ends", -2)).otherwise(F.lit(0))
    out = out.withColumn("m2", m2)
    offset_ok = (F.col("gmin") == F.col("m2") + 1) & (F.col("m2") <= F.least(F.lit(K.MAX_PREAMBLE_LINES), F.col("n_lines") - 2))
    return out.select(
        "file_id", "n_lines", "whole_delim", "tail_delim", "delimiter",
        (F.col("max_fc") == 1).alias("single_column"),
        "w1", "width", "n_widths",
        F.when(offset_ok, F.col("m2")).cast("long").alias("offset"),
    )


# ------------------------------------------------------------------- D9, D10
def head_lines(lines: DataFrame, upto: int = K.MAX_PREAMBLE_LINES + 1) -> DataFrame:
    return lines.filter(F.col("line_no") <= upto).select("file_id", "line_no", "raw")


def garbled_header(lines: DataFrame, struct_df: DataFrame, file_bound: int | None = None,
                   head: DataFrame | None = None) -> DataFrame:
    """For files with offset > 0: is line ``offset`` the real header, mangled
    by several stray delimiters? (D9). Returns file_id, line_no,
    observed_delimiter, repaired_text for the files where it is."""
    cand = struct_df.filter(F.col("offset") > 0).select("file_id", F.col("offset").alias("line_no"), "delimiter", "width")
    head = head if head is not None else head_lines(lines)
    j = head.join(sized_broadcast(cand, file_bound), ["file_id", "line_no"])
    cands = T.stray_candidates(F.col("raw"), F.col("delimiter"))
    j = j.withColumn("cands", cands)
    pattern = F.array_join(F.transform("cands", T.quote_regex), "|")
    normalized = F.regexp_replace(F.col("raw"), pattern, T.regex_replacement(F.col("delimiter")))
    j = j.withColumn("normalized", normalized)
    ok = (F.size("cands") > 0) & (T.field_count(F.col("normalized"), F.col("delimiter")) == F.col("width"))
    return j.filter(ok).select(
        "file_id", "line_no",
        F.array_join("cands", "/").alias("observed_delimiter"),
        F.col("normalized").alias("repaired_text"),
        F.col("width").alias("expected_field_count"),
        T.field_count(F.col("raw"), F.col("delimiter")).alias("actual_field_count"),
        F.col("raw").alias("original_text"),
    )


# ------------------------------------------------------------- field parsing
def quoted_split(line: Column, delim: Column) -> Column:
    """Fields of a line that may hold quoted fields: split outside quotes
    (an even number of quotes behind), then unquoted.

    The pieces between quote signs alternate between outside and inside,
    counted from the line's end, so one pass marks the delimiters outside
    with a sentinel; the line is then split on the sentinel literally. In a
    line that already holds the sentinel, it is escaped meanwhile."""
    held = F.instr(line, _SENTINEL) > 0
    safe = F.when(held, F.replace(F.replace(line, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_SENTINEL), F.lit(_ESCAPE + "a"))).otherwise(line)
    marked = T.let(F.split(safe, '"', -1), lambda pieces: T.let(F.size(pieces) - 1, lambda last: F.array_join(
        F.transform(pieces, lambda p, i: F.when(F.pmod(last - i, F.lit(2)) == 0, F.replace(p, delim, F.lit(_SENTINEL))).otherwise(p)), '"')))
    parts = F.split(marked, _SENTINEL, -1)
    restored = F.transform(parts, lambda f: F.replace(F.replace(f, F.lit(_ESCAPE + "a"), F.lit(_SENTINEL)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE)))
    return F.transform(
        F.when(held, restored).otherwise(parts),
        lambda f: F.when(f.rlike(f"^{T.QUOTED}$"), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def with_fields(df: DataFrame, raw: str = "raw", d: str = "delimiter", out: str = "fields") -> DataFrame:
    """Append ``fields``: unquoted lines split literally, lines holding a
    double quote outside quotes. No Python in this path."""
    line, delim = F.col(raw), F.col(d)
    return df.withColumn(out, F.when(F.instr(line, '"') > 0, quoted_split(line, delim)).otherwise(T.split_fields(line, delim)))


# --------------------------------------------------------------- D11, D12, D13
def numeric_columns(lines: DataFrame, struct_df: DataFrame, file_bound: int | None = None) -> DataFrame:
    """Positions (0-based) where every data value (lines >= 2) parses as a
    number, for files consistent from line 1 (D11).

    No row per value: each line becomes one bitmask of its non-numeric
    positions per 63 columns, masks are OR-ed per (file, word) map-side,
    and a position is numeric when it exists (below the widest line) and
    no line set its bit."""
    files = struct_df.filter((F.col("offset") == 0) & ~F.col("single_column")).select("file_id", "delimiter")
    data = lines.filter(F.col("line_no") >= 2).join(sized_broadcast(files, file_bound), "file_id")
    fl = with_fields(data).select("file_id", "fields", F.size("fields").alias("n"))
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")

    def word(k):
        bits = F.transform(F.slice("fields", k * _WORD + 1, _WORD),
                           lambda v, i: F.when(~T.parses_float(v), F.call_function("shiftleft", one, i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda a, b: a.bitwiseOR(b))

    masks = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _WORD).cast("int")), word)
    words = fl.select("file_id", "n", F.posexplode(masks).alias("w", "m")) \
        .groupBy("file_id", "w").agg(F.bit_or("m").alias("m"), F.max("n").alias("n"))
    pos = F.explode(F.sequence(F.col("w") * _WORD, F.least(F.col("n"), (F.col("w") + 1) * _WORD) - 1))
    cand = words.select("file_id", "w", "m", pos.alias("pos"))
    bit = F.call_function("shiftright", F.col("m"), (F.col("pos") - F.col("w") * _WORD).cast("int")).bitwiseAND(one)
    return cand.filter(bit == 0).select("file_id", F.col("pos").cast("long").alias("pos"))


def header_checks(lines: DataFrame, struct_df: DataFrame, file_bound: int | None = None,
                  bom_files: DataFrame | None = None, head: DataFrame | None = None) -> DataFrame:
    """file_id, looks_headerless (D12), invisible (D13) for files consistent
    from line 1."""
    files = struct_df.filter((F.col("offset") == 0) & ~F.col("single_column")).select("file_id", "delimiter")
    head = head if head is not None else head_lines(lines)
    first = head.filter(F.col("line_no") == 1).join(sized_broadcast(files, file_bound), "file_id")
    first = with_fields(first).select("file_id", "fields", "raw")
    num = numeric_columns(lines, struct_df, file_bound)
    hdr = first.select("file_id", F.posexplode("fields").alias("pos", "v"))
    checked = num.join(hdr.withColumn("pos", F.col("pos").cast("long")), ["file_id", "pos"], "left") \
        .groupBy("file_id").agg(
            F.bool_and(F.coalesce(T.parses_float(F.col("v")), F.lit(False))).alias("all_numeric"))
    inv = T.has_invisible(F.array_join("fields", "\u0001"))
    if bom_files is not None:
        first = first.join(bom_files.select("file_id", "bom_utf8"), "file_id", "left")
        inv = inv | F.coalesce(F.col("bom_utf8"), F.lit(False))
    return first.join(checked, "file_id", "left").select(
        "file_id",
        F.coalesce(F.col("all_numeric"), F.lit(False)).alias("looks_headerless"),
        inv.alias("invisible"),
    )


# --------------------------------------------------------- D14, D15, D16, D18
def _resolve(raw: Column, d: Column, expected: Column, split=T.split_fields) -> Column:
    """Struct (observed, repaired) of a row, null fields when unresolved. Tier 1: one
    other delimiter splits the whole line to the expected width. Tier 2: one field holds
    the missing fields. ``split`` is quote-aware for lines that hold a double quote.
    The fields and both tiers' hits are bound once per row."""
    strays = T.stray_candidates(raw, d)
    whole = F.filter(strays, lambda c: F.size(split(raw, c)) == expected)

    def inner(fields: Column, deficit: Column) -> Column:
        return F.flatten(F.transform(fields, lambda f, i: F.transform(
            F.filter(T.stray_candidates(f, d), lambda c: F.size(split(f, c)) - 1 == deficit),
            lambda c: F.struct(i.alias("i"), c.alias("c")))))

    def spliced(fields: Column, hit: Column) -> Column:
        rest = F.slice(fields, hit["i"] + 2, F.greatest(F.size(fields) - hit["i"] - 1, F.lit(0)))
        return F.concat(F.slice(fields, 1, hit["i"]), split(F.element_at(fields, hit["i"] + 1), hit["c"]), rest)

    none = F.lit(None).cast("string")
    row = lambda observed, fields: F.struct(observed.alias("observed"), T.csv_join(fields, d).alias("repaired"))
    unresolved = F.struct(none.alias("observed"), none.alias("repaired"))

    def second(fields: Column) -> Column:
        hits = T.let(expected - F.size(fields), lambda deficit: F.when(deficit > 0, inner(fields, deficit)))
        return T.let(hits, lambda h: F.when(F.size(h) == 1, T.let(F.element_at(h, 1), lambda hit: row(hit["c"], spliced(fields, hit))))
                     .otherwise(unresolved))

    return T.let(whole, lambda w: F.when(F.size(w) == 1, T.let(F.element_at(w, 1), lambda c: row(c, split(raw, c))))
                 .otherwise(T.let(split(raw, d), second)))


def disagreeing_rows(lines: DataFrame, struct_df: DataFrame, file_bound: int | None = None) -> DataFrame:
    """Lines after line 1 whose width differs from line 1's, for files with
    no header offset, each with its resolution (null when unresolved)."""
    files = struct_df.filter(F.col("offset").isNull() & ~F.col("single_column") & (F.col("n_lines") >= 2)) \
        .select("file_id", "delimiter", F.col("w1").alias("expected_field_count"))
    j = lines.filter(F.col("line_no") > 1).join(sized_broadcast(files, file_bound), "file_id")
    j = j.withColumn("actual_field_count", T.field_count(F.col("raw"), F.col("delimiter")))
    bad = j.filter(F.col("actual_field_count") != F.col("expected_field_count"))
    def resolved(part: DataFrame, split) -> DataFrame:
        res = part.withColumn("_res", _resolve(F.col("raw"), F.col("delimiter"), F.col("expected_field_count"), split))
        return res.withColumn("observed_delimiter", F.col("_res.observed")).withColumn("repaired_text", F.col("_res.repaired"))
    plain = resolved(bad.filter(F.instr("raw", '"') == 0), T.split_fields)
    quoted = resolved(bad.filter(F.instr("raw", '"') > 0), quoted_split)
    return plain.unionByName(quoted).select(
        "file_id", F.col("line_no").alias("row_number"), "expected_field_count", "actual_field_count",
        "observed_delimiter", F.col("raw").alias("original_text"), "repaired_text", "delimiter",
    )


def row_repairs(disagree: DataFrame, classes: DataFrame) -> DataFrame:
    """Row repairs of mixed_delimiter files only (D18): every disagreeing row
    of such a file resolved, so evidence and class always agree (Q5)."""
    mixed = classes.filter(F.array_contains("failure_classes", "mixed_delimiter")).select("file_id")
    return disagree.join(mixed, "file_id", "left_semi")


# ------------------------------------------------------------ D17, D19, D20
def classify(struct_df: DataFrame, garbled: DataFrame, hdr: DataFrame, disagree: DataFrame,
             encoding: DataFrame | None = None, file_bound: int | None = None) -> DataFrame:
    """One row per file: failure_classes (sorted array), primary, offsets.
    The frames joined to the structure hold at most one row per file, so
    they are broadcast behind the file bound (no exchange of the left side)."""
    mixed = disagree.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_disagree"),
        F.bool_and(F.col("observed_delimiter").isNotNull()).alias("all_resolved"),
    )
    per_file = lambda x: sized_broadcast(x, file_bound)
    df = struct_df.join(per_file(garbled.select("file_id", F.lit(True).alias("garbled"))), "file_id", "left") \
        .join(per_file(hdr), "file_id", "left").join(per_file(mixed), "file_id", "left")
    if encoding is not None:
        df = df.join(per_file(encoding.select("file_id", "wrong_encoding")), "file_id", "left")
    else:
        df = df.withColumn("wrong_encoding", F.lit(False))
    garbled_c = F.coalesce(F.col("garbled"), F.lit(False))
    eff = F.when(garbled_c, F.col("offset") - 1).otherwise(F.col("offset"))
    enough = F.col("n_lines") >= 2
    structural = enough & ~F.col("single_column")
    consistent = structural & F.col("offset").isNotNull()
    hdr_det = consistent & ((eff > 0) | garbled_c)
    plain = consistent & ~hdr_det
    mixed_c = structural & F.col("offset").isNull() & F.coalesce(F.col("all_resolved"), F.lit(False)) \
        & (F.coalesce(F.col("n_disagree"), F.lit(0)) > 0)
    engine = structural & F.col("offset").isNull() & ~mixed_c
    flags = {
        "wrong_encoding": F.coalesce(F.col("wrong_encoding"), F.lit(False)),
        "wrong_delimiter": enough & (F.col("delimiter") != K.DEFAULT_DELIMITER),
        "header_detection": hdr_det,
        "no_header": plain & F.coalesce(F.col("looks_headerless"), F.lit(False)),
        "invisible_characters": plain & F.coalesce(F.col("invisible"), F.lit(False)),
        "mixed_delimiter": mixed_c,
        "engine_selection": engine,
        "single_column_malformation": enough & F.col("single_column"),
    }
    classes = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()])))
    primary = F.coalesce(*[F.when(flags[name], F.lit(name)) for name in K.FAILURE_PRIORITY])
    return df.select(
        "file_id", "n_lines", "delimiter", "offset",
        F.when(consistent, eff).cast("long").alias("effective_offset"),
        garbled_c.alias("garbled_header"),
        classes.alias("failure_classes"),
        primary.alias("primary_class"),
    )


def detect(lines: DataFrame, file_bound: int | None = None, encoding: DataFrame | None = None,
           bom_files: DataFrame | None = None, cut: bool = True,
           lines_materialized: bool = False) -> dict[str, DataFrame]:
    """All detection frames for a set of files.

    Full passes over ``lines``: the shape aggregate, the numeric-column
    check of consistent files and the disagreeing rows of the others. With
    ``cut`` the numbered lines are written once (sorted by file and line, so
    the head filters prune row groups) unless the caller already did, and
    the small per-file frames and head lines (<= 11 per file) are written
    too, so no branch repeats the scan, the numbering or the shape
    aggregate.
    """
    keep = cut_lineage if cut else (lambda x: x)
    if cut and not lines_materialized:
        lines = cut_lineage(lines.sortWithinPartitions("file_id", "line_no"), "lines")
    groups = keep(shape_groups(lines))  # a few rows per file and candidate
    st = keep(structure(lines, groups))
    head = keep(head_lines(lines))  # at most 11 lines per file
    garbled = garbled_header(lines, st, file_bound, head)
    hdr = header_checks(lines, st, file_bound, bom_files, head)
    disagree = keep(disagreeing_rows(lines, st, file_bound))
    classes = keep(classify(st, garbled, hdr, disagree, encoding, file_bound))
    return {"groups": groups, "structure": st, "garbled": garbled, "header": hdr,
            "disagree": disagree, "classes": classes}
