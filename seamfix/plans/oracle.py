"""DuckDB oracle SQL for the query catalogue.

Each oracle is written directly in SQL against the pre-registered driver
views (``orders``, ``customer``, ``events`` ...). ``LINES`` renders the
damaged files exactly as ``seamfix.sources.render`` does, from the same
rules (SURVEY 7.3), so every query reads the whole driver table.
"""

from __future__ import annotations

# Rendered lines of the 64 damaged files: lines(file_id, line_no, raw, n_lines).
LINES = r"""
o AS (
  SELECT o_custkey % 64 AS file_id, (o_custkey % 64) % 16 AS fault,
         o_orderstatus AS s, CAST(o_orderkey AS VARCHAR) AS ok,
         CAST(o_custkey AS VARCHAR) AS ck, o_orderpriority AS p,
         row_number() OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderkey) AS k
  FROM orders
),
od AS (
  SELECT *,
    CASE fault WHEN 1 THEN ';' WHEN 2 THEN '|' WHEN 8 THEN ' ' WHEN 9 THEN chr(9)
               WHEN 10 THEN ':' WHEN 12 THEN ';' ELSE ',' END AS d,
    CASE fault WHEN 3 THEN 3 WHEN 11 THEN 2 WHEN 12 THEN 2 ELSE 0 END AS npre,
    CASE WHEN fault IN (4, 13) THEN 0 ELSE 1 END AS hdr
  FROM o
),
nd AS (SELECT file_id, count(*) AS n_data FROM o GROUP BY file_id),
fl AS (SELECT DISTINCT od.file_id, fault, d, npre, hdr, n_data FROM od JOIN nd USING (file_id)),
pre(fault, pos, raw) AS (VALUES
  (3, 1, 'Orders taken at the counter'), (3, 2, 'copied out by the evening shift'), (3, 3, 'northern branch'),
  (11, 1, 'Orders taken at the counter'), (11, 2, 'northern branch'),
  (12, 1, 'ledger pages of the quarter'), (12, 2, 'second copy')
),
lines AS (
  SELECT od.file_id, CAST(k + npre + hdr AS BIGINT) AS line_no,
    CASE
      WHEN fault = 6 AND k % 10 = 3 THEN s || ';' || ok || ';' || ck || ';' || p
      WHEN fault = 6 AND k % 10 = 5 THEN s || ',' || ok || ';' || ck || ',' || p
      WHEN fault = 7 AND k % 10 = 3 THEN s || ',' || ok || ',' || ck || ',' || p || ',extra'
      WHEN fault = 14 AND k % 10 = 3 THEN s || ',' || ok || ',' || ck
      WHEN fault = 15 AND k % 10 = 3 THEN s || '|' || ok || '|' || ck || '|' || p
      WHEN fault = 15 AND k % 10 = 5 THEN s || ';' || ok || ';' || ck || ';' || p
      WHEN fault = 13 AND k = 1 THEN chr(8203) || s || ',' || ok || ',' || ck || ',' || p
      ELSE s || d || ok || d || ck || d || p
    END AS raw,
    CAST(n_data + npre + hdr AS BIGINT) AS n_lines
  FROM od JOIN nd USING (file_id)
  UNION ALL
  SELECT file_id, CAST(npre + 1 AS BIGINT),
    CASE fault
      WHEN 11 THEN 'o_orderstatus;o_orderkey|o_custkey,o_orderpriority'
      WHEN 5 THEN chr(8203) || 'o_orderstatus,o_orderkey,o_custkey,o_orderpriority'
      ELSE 'o_orderstatus' || d || 'o_orderkey' || d || 'o_custkey' || d || 'o_orderpriority'
    END,
    CAST(n_data + npre + hdr AS BIGINT)
  FROM fl WHERE hdr = 1
  UNION ALL
  SELECT file_id, CAST(pos AS BIGINT), pre.raw, CAST(n_data + npre + hdr AS BIGINT)
  FROM fl JOIN pre USING (fault)
)
"""


def with_lines(body: str) -> str:
    return "WITH " + LINES.strip() + ",\n" + body.strip()

# Stray-delimiter character class and Python float grammar (RE2 flavour).
CLS = r"""([^\p{L}\p{N}\-_.''"@ ])"""  # quote doubled for a SQL literal
FLOAT = (
    r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?(?:e[+-]?\d+(?:_\d+)*)?"
    r"|\.\d+(?:_\d+)*(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?|nan)\s*$"
)
INVIS = r"[\x{FEFF}\x{200B}\x{200C}\x{200D}\x{2060}]"


def _csvjoin(lst: str, d: str) -> str:
    return (f"array_to_string(list_transform({lst}, lambda f: CASE WHEN contains(f, '\"') OR contains(f, {d}) "
            f"OR contains(f, chr(13)) OR contains(f, chr(10)) THEN '\"' || replace(f, '\"', '\"\"') || '\"' "
            f"ELSE f END), chr(31)).replace(chr(31), {d})")


# Detection chain over ``lines`` (independent SQL formulation of D3-D20).
DETECT = rf"""
shape AS (
  SELECT file_id, line_no, n_lines, raw, cand,
         length(raw) - length(replace(raw, cand, '')) AS occ,
         line_no > n_lines - 5 AS is_tail
  FROM (SELECT *, unnest([',', chr(9), ';', ':', '|']) AS cand FROM lines)
),
prefs AS (SELECT cand, pref FROM (VALUES (',', 0), (chr(9), 1), (';', 2), (':', 3), ('|', 4)) t(cand, pref)),
hist AS (
  SELECT file_id, cand, occ, count(*) AS cnt, count(*) FILTER (WHERE is_tail) AS cnt_tail
  FROM shape GROUP BY file_id, cand, occ
),
wmode AS (
  SELECT file_id, cand, occ AS mocc, cnt AS m, sum(cnt) OVER (PARTITION BY file_id, cand) AS n,
         row_number() OVER (PARTITION BY file_id, cand ORDER BY cnt DESC, occ DESC) AS rk
  FROM hist
),
tmode AS (
  SELECT file_id, cand, occ AS mocc, cnt_tail AS m, sum(cnt_tail) OVER (PARTITION BY file_id, cand) AS n,
         row_number() OVER (PARTITION BY file_id, cand ORDER BY cnt_tail DESC, occ DESC) AS rk
  FROM hist WHERE cnt_tail > 0
),
wpick AS (
  SELECT file_id, cand AS whole_delim FROM (
    SELECT w.file_id, w.cand, row_number() OVER (PARTITION BY w.file_id
             ORDER BY floor((2 * m - n) * 100.0 / n) DESC, p.pref) AS r2
    FROM wmode w JOIN prefs p USING (cand)
    WHERE rk = 1 AND mocc > 0 AND (2 * m - n) * 10 >= 9 * n) WHERE r2 = 1
),
tpick AS (
  SELECT file_id, cand AS tail_delim FROM (
    SELECT t.file_id, t.cand, row_number() OVER (PARTITION BY t.file_id
             ORDER BY floor((2 * m - n) * 100.0 / n) DESC, p.pref) AS r2
    FROM tmode t JOIN prefs p USING (cand)
    WHERE rk = 1 AND mocc > 0 AND (2 * m - n) * 10 >= 9 * n) WHERE r2 = 1
),
vote AS (
  SELECT f.file_id, f.n_lines, w.whole_delim, t.tail_delim,
         coalesce(w.whole_delim, t.tail_delim, ',') AS delimiter
  FROM (SELECT DISTINCT file_id, n_lines FROM lines) f
  LEFT JOIN wpick w USING (file_id) LEFT JOIN tpick t USING (file_id)
),
fcs AS (
  SELECT s.file_id, s.line_no, s.raw, s.occ + 1 AS fc
  FROM shape s JOIN vote v ON s.file_id = v.file_id AND s.cand = v.delimiter
),
fstat AS (SELECT file_id, max(fc) AS max_fc, arg_min(fc, line_no) AS w1 FROM fcs GROUP BY file_id),
nn AS (
  SELECT file_id, unnest(range(0, least(10, n_lines - 2) + 1)) AS nn FROM vote WHERE n_lines >= 2
),
chk AS (
  SELECT nn.file_id, nn.nn,
         count(DISTINCT f.fc) FILTER (WHERE f.line_no > nn.nn) AS k,
         min(f.fc) FILTER (WHERE f.line_no > nn.nn) AS w,
         count(*) FILTER (WHERE f.line_no > nn.nn) AS tail_len
  FROM nn JOIN fcs f USING (file_id) GROUP BY nn.file_id, nn.nn
),
chk2 AS (
  SELECT c.*, (SELECT count(*) FROM fcs f WHERE f.file_id = c.file_id AND f.line_no <= c.nn AND f.fc = c.w) AS pre_hits
  FROM chk c
),
offs AS (
  SELECT file_id, min(nn) AS off, arg_min(w, nn) AS width
  FROM chk2 WHERE k = 1 AND tail_len >= 2 AND pre_hits = 0 GROUP BY file_id
),
struct AS (
  SELECT v.*, fs.max_fc = 1 AS single_column, fs.w1, o.off, o.width
  FROM vote v JOIN fstat fs USING (file_id) LEFT JOIN offs o USING (file_id)
),
gcand AS (
  SELECT s.file_id, f.line_no, f.raw, s.delimiter, s.width,
         list_sort(list_filter(list_distinct(regexp_extract_all(f.raw, '{CLS}', 1)), lambda c: c <> s.delimiter)) AS cands
  FROM struct s JOIN fcs f ON f.file_id = s.file_id AND f.line_no = s.off
  WHERE s.off > 0 AND NOT s.single_column
),
gnorm AS (SELECT *, translate(raw, array_to_string(cands, ''), repeat(delimiter, len(cands))) AS normalized FROM gcand),
garbled AS (
  SELECT file_id, line_no, array_to_string(cands, '/') AS observed_delimiter, normalized AS repaired_text,
         width AS expected_field_count
  FROM gnorm
  WHERE len(cands) > 0 AND length(normalized) - length(replace(normalized, delimiter, '')) + 1 = width
),
cons AS (SELECT file_id, delimiter FROM struct WHERE off = 0 AND NOT single_column),
dvals AS (
  SELECT l.file_id, unnest(range(len(string_split(l.raw, c.delimiter)))) AS pos,
         unnest(string_split(l.raw, c.delimiter)) AS v
  FROM lines l JOIN cons c USING (file_id) WHERE l.line_no >= 2
),
numcols AS (
  SELECT file_id, pos FROM dvals GROUP BY file_id, pos HAVING bool_and(regexp_matches(v, '{FLOAT}'))
),
hvals AS (
  SELECT l.file_id, unnest(range(len(string_split(l.raw, c.delimiter)))) AS pos,
         unnest(string_split(l.raw, c.delimiter)) AS v
  FROM lines l JOIN cons c USING (file_id) WHERE l.line_no = 1
),
hnum AS (
  SELECT n.file_id, bool_and(coalesce(regexp_matches(h.v, '{FLOAT}'), false)) AS all_numeric
  FROM numcols n LEFT JOIN hvals h ON h.file_id = n.file_id AND h.pos = n.pos GROUP BY n.file_id
),
hdr AS (
  SELECT c.file_id, coalesce(hn.all_numeric, false) AS looks_headerless,
         regexp_matches(l.raw, '{INVIS}') AS invisible
  FROM cons c JOIN lines l ON l.file_id = c.file_id AND l.line_no = 1
  LEFT JOIN hnum hn ON hn.file_id = c.file_id
),
incons AS (SELECT file_id, delimiter, w1 FROM struct WHERE off IS NULL AND NOT single_column AND n_lines >= 2),
bad AS (
  SELECT f.file_id, f.line_no, f.raw, i.delimiter AS d, i.w1 AS expected, f.fc AS actual,
         string_split(f.raw, i.delimiter) AS fields
  FROM fcs f JOIN incons i USING (file_id) WHERE f.line_no > 1 AND f.fc <> i.w1
),
res AS (
  SELECT *,
    list_filter(list_sort(list_filter(list_distinct(regexp_extract_all(raw, '{CLS}', 1)), lambda c: c <> d)),
                lambda c: len(string_split(raw, c)) = expected) AS t1,
    flatten(list_transform(range(len(fields)), lambda i:
      list_transform(
        list_filter(list_sort(list_filter(list_distinct(regexp_extract_all(fields[i + 1], '{CLS}', 1)), lambda c: c <> d)),
                    lambda c: len(string_split(fields[i + 1], c)) - 1 = expected - actual),
        lambda c: {{'i': i, 'c': c}}))) AS t2
  FROM bad
),
resolved AS (
  SELECT file_id, line_no AS row_number, expected AS expected_field_count, actual AS actual_field_count,
    CASE WHEN len(t1) = 1 THEN t1[1] WHEN actual < expected AND len(t2) = 1 THEN t2[1].c END AS observed_delimiter,
    raw AS original_text,
    CASE WHEN len(t1) = 1 THEN {_csvjoin("string_split(raw, t1[1])", "d")}
         WHEN actual < expected AND len(t2) = 1 THEN
           {_csvjoin("fields[1:t2[1].i] || string_split(fields[t2[1].i + 1], t2[1].c) || fields[t2[1].i + 2:]", "d")}
    END AS repaired_text
  FROM res
),
mixed AS (
  SELECT file_id, count(*) AS n_disagree, bool_and(observed_delimiter IS NOT NULL) AS all_resolved
  FROM resolved GROUP BY file_id
),
flags AS (
  SELECT s.file_id, s.n_lines, s.delimiter, s.off,
    s.n_lines >= 2 AND s.delimiter <> ',' AS f_delim,
    s.n_lines >= 2 AND s.single_column AS f_single,
    s.n_lines >= 2 AND NOT s.single_column AND s.off IS NOT NULL AND (s.off - (g.file_id IS NOT NULL)::INT > 0 OR g.file_id IS NOT NULL) AS f_header,
    s.n_lines >= 2 AND NOT s.single_column AND s.off = 0 AND coalesce(h.looks_headerless, false) AS f_nohdr,
    s.n_lines >= 2 AND NOT s.single_column AND s.off = 0 AND coalesce(h.invisible, false) AS f_invis,
    s.n_lines >= 2 AND NOT s.single_column AND s.off IS NULL AND coalesce(m.all_resolved, false) AND coalesce(m.n_disagree, 0) > 0 AS f_mixed,
    s.n_lines >= 2 AND NOT s.single_column AND s.off IS NULL AND NOT (coalesce(m.all_resolved, false) AND coalesce(m.n_disagree, 0) > 0) AS f_engine,
    CASE WHEN s.off IS NOT NULL AND NOT s.single_column AND s.n_lines >= 2 THEN s.off - (g.file_id IS NOT NULL)::INT END AS effective_offset
  FROM struct s LEFT JOIN garbled g USING (file_id) LEFT JOIN hdr h USING (file_id) LEFT JOIN mixed m USING (file_id)
),
classes AS (
  SELECT file_id, n_lines, delimiter, off, effective_offset,
    list_sort(list_filter([
      CASE WHEN f_delim THEN 'wrong_delimiter' END, CASE WHEN f_header THEN 'header_detection' END,
      CASE WHEN f_nohdr THEN 'no_header' END, CASE WHEN f_invis THEN 'invisible_characters' END,
      CASE WHEN f_mixed THEN 'mixed_delimiter' END, CASE WHEN f_engine THEN 'engine_selection' END,
      CASE WHEN f_single THEN 'single_column_malformation' END], lambda x: x IS NOT NULL)) AS cls,
    CASE WHEN f_delim THEN 'wrong_delimiter' WHEN f_header THEN 'header_detection'
         WHEN f_nohdr THEN 'no_header' WHEN f_invis THEN 'invisible_characters'
         WHEN f_mixed THEN 'mixed_delimiter' WHEN f_engine THEN 'engine_selection'
         WHEN f_single THEN 'single_column_malformation' END AS primary_class
  FROM flags
)
"""


def with_detect(body: str) -> str:
    return "WITH " + LINES.strip() + ",\n" + DETECT.strip() + ",\n" + body.strip()


def detection_oracles() -> dict[str, str]:
    q = {}
    q["scan_numbered_lines"] = with_lines("SELECT file_id, line_no, raw, n_lines FROM lines")
    q["sample_head"] = with_lines(
        "SELECT file_id, string_agg(raw, chr(10) ORDER BY line_no) AS sample FROM lines "
        "WHERE line_no <= 5 GROUP BY file_id")
    q["delimiter_vote"] = with_detect(
        "SELECT file_id, n_lines, whole_delim, tail_delim, delimiter FROM vote")
    q["field_count_histogram"] = with_detect(
        "SELECT file_id, CAST(fc AS BIGINT) AS field_count, count(*) AS n_rows FROM fcs GROUP BY file_id, fc")
    q["detect_wrong_delimiter"] = with_detect(
        "SELECT file_id, delimiter FROM struct WHERE n_lines >= 2 AND delimiter <> ','")
    q["detect_single_column"] = with_detect(
        "SELECT file_id, n_lines FROM struct WHERE n_lines >= 2 AND single_column")
    q["header_offset"] = with_detect(
        "SELECT file_id, CAST(off AS BIGINT) AS header_offset, CAST(effective_offset AS BIGINT) AS effective_offset, "
        "f_header AS header_detection FROM flags WHERE effective_offset IS NOT NULL")
    q["garbled_header"] = with_detect(
        "SELECT file_id, CAST(line_no AS BIGINT) AS line_no, observed_delimiter, repaired_text FROM garbled")
    q["numeric_columns"] = with_detect("SELECT file_id, CAST(pos AS BIGINT) AS pos FROM numcols")
    q["detect_no_header"] = with_detect("SELECT file_id FROM flags WHERE f_nohdr")
    q["detect_invisible"] = with_detect("SELECT file_id FROM flags WHERE f_invis")
    q["mixed_rows"] = with_detect(
        "SELECT r.file_id, CAST(r.row_number AS BIGINT) AS row_number, CAST(r.expected_field_count AS BIGINT) AS expected_field_count, "
        "CAST(r.actual_field_count AS BIGINT) AS actual_field_count, r.observed_delimiter, r.original_text, r.repaired_text "
        "FROM resolved r JOIN flags f USING (file_id) WHERE f.f_mixed")
    q["failure_classes"] = with_detect(
        "SELECT file_id, array_to_string(cls, ',') AS failure_classes, CAST(len(cls) AS BIGINT) AS n_classes FROM classes")
    q["primary_class"] = with_detect(
        "SELECT file_id, primary_class FROM classes WHERE primary_class IS NOT NULL")
    return q


def all_oracles() -> dict[str, str]:
    """Every oracle, keyed like the catalogue."""
    q = {}
    for name, fn in list(globals().items()):
        if name.endswith("_oracles") and name != "all_oracles" and callable(fn):
            q.update(fn())
    return q


def _codec_values() -> str:
    """Known codec names (same stdlib alias rule as the Spark side)."""
    import encodings.aliases
    names = set(encodings.aliases.aliases) | set(encodings.aliases.aliases.values())
    rows = sorted({n.lower().replace("-", "_").replace(" ", "_") for n in names})
    return ", ".join(f"('{r}')" for r in rows)


def _prop(supplied: bool) -> str:
    d = "d." if supplied else "NULL::VARCHAR AS "
    join = ("LEFT JOIN (VALUES ('wrong_delimiter', ';', 'utf-8', 0, 'python'), ('wrong_encoding', ',', 'latin-1', 0, 'python'),"
            " ('header_detection', ',', 'utf-8', 1, 'python'), ('engine_selection', ',', 'utf-8', 0, 'pyarrow'),"
            " ('single_column_malformation', ';', 'utf-8', 0, 'python')) d(cls_name, delimiter, encoding, header_row, engine)"
            " ON d.cls_name = c.primary_class") if supplied else ""
    sup = (lambda col, dflt: f"coalesce(d.{col}, {dflt})") if supplied else (lambda col, dflt: dflt)
    return f"""
prop AS (
  SELECT c.file_id, c.primary_class, c.cls,
    CASE WHEN (list_contains(c.cls, 'mixed_delimiter') AND coalesce(nm.n, 0) > 0) OR g.file_id IS NOT NULL THEN c.delimiter
         ELSE {sup('delimiter', "CASE WHEN list_contains(c.cls, 'single_column_malformation') THEN p10.c ELSE c.delimiter END")} END AS delimiter,
    {sup('encoding', "'utf-8'")} AS encoding,
    CAST(CASE WHEN list_contains(c.cls, 'no_header') THEN NULL
              WHEN list_contains(c.cls, 'header_detection') THEN c.effective_offset
              ELSE {sup('header_row', '0')} END AS BIGINT) AS header_row,
    {sup('engine', "'python'")} AS engine,
    CAST(CASE WHEN g.file_id IS NOT NULL THEN 1
              WHEN list_contains(c.cls, 'mixed_delimiter') AND coalesce(nm.n, 0) > 0 THEN nm.n ELSE 0 END AS BIGINT) AS n_row_repairs
  FROM classes c LEFT JOIN garbled g USING (file_id) LEFT JOIN nmix nm USING (file_id) LEFT JOIN p10 USING (file_id)
  {join}
  WHERE len(c.cls) > 0
)"""


REPAIR_BASE = r"""
p10c AS (
  SELECT l.file_id, unnest(list_distinct(regexp_extract_all(l.raw, '([^\p{L}\p{N}])', 1))) AS c
  FROM lines l JOIN struct s USING (file_id) WHERE l.line_no = 1 AND s.single_column AND s.n_lines >= 2
),
p10w AS (
  SELECT p.file_id, p.c, min(length(l.raw) - length(replace(l.raw, p.c, '')) + 1) AS lo,
         max(length(l.raw) - length(replace(l.raw, p.c, '')) + 1) AS hi
  FROM p10c p JOIN lines l USING (file_id) WHERE p.c NOT IN (',', ';', chr(9), '|', ':') GROUP BY p.file_id, p.c
),
p10 AS (SELECT file_id, max(c) AS c FROM p10w WHERE lo = hi AND lo >= 2 GROUP BY file_id HAVING count(*) = 1),
nmix AS (SELECT r.file_id, count(*) AS n FROM resolved r JOIN flags f USING (file_id) WHERE f.f_mixed GROUP BY r.file_id)
"""


def repair_chain(supplied: bool = False) -> str:
    inv = INVIS
    return REPAIR_BASE.strip() + ",\n" + _prop(supplied).strip() + ",\n" + rf"""
codecs(codec) AS (VALUES {_codec_values()}),
val AS (
  SELECT p.*, list_filter([
      CASE WHEN delimiter IS NULL THEN 'delimiter: missing' END,
      CASE WHEN length(delimiter) <> 1 THEN 'delimiter: must be exactly one character' END,
      CASE WHEN encoding IS NULL OR trim(encoding) = '' THEN 'encoding: missing'
           WHEN NOT EXISTS (SELECT 1 FROM codecs k WHERE k.codec = regexp_replace(lower(trim(p.encoding)), '[-\s]', '_', 'g'))
           THEN 'encoding: unknown encoding ' || trim(encoding) END,
      CASE WHEN header_row < 0 THEN 'header_row: must be >= 0 or null' END,
      CASE WHEN engine NOT IN ('python', 'c', 'pyarrow') THEN 'engine: must be one of python, c, pyarrow' END
    ], lambda x: x IS NOT NULL) AS errs
  FROM prop p
),
gatedq AS (
  SELECT *, len(errs) = 0 AS valid, len(errs) = 0 AND file_id % 8 <> 7 AS approved,
         CASE WHEN n_row_repairs > 0 THEN 'row_level' ELSE 'whole_file' END AS executor
  FROM val
),
plan AS (SELECT file_id, delimiter, header_row, executor FROM gatedq WHERE approved),
fix AS (
  SELECT r.file_id, r.row_number AS line_no, r.repaired_text FROM resolved r JOIN flags f USING (file_id) WHERE f.f_mixed
  UNION ALL SELECT file_id, line_no, repaired_text FROM garbled
),
kept AS (
  SELECT l.file_id, l.line_no, p.delimiter, p.header_row, p.executor,
         CASE WHEN p.executor = 'row_level' THEN coalesce(fx.repaired_text, l.raw) ELSE l.raw END AS text
  FROM lines l JOIN plan p USING (file_id)
  LEFT JOIN fix fx ON fx.file_id = l.file_id AND fx.line_no = l.line_no
  WHERE l.line_no > coalesce(p.header_row, 0)
),
kw AS (SELECT *, string_split(text, delimiter) AS fields, len(string_split(text, delimiter)) AS width FROM kept),
kper AS (SELECT file_id, arg_min(width, line_no) AS expected, min(line_no) AS first_line, count(*) AS n_kept FROM kw GROUP BY file_id),
rerr AS (
  SELECT k.file_id, k.line_no AS row_number,
         printf('row %d: expected %d fields, found %d', k.line_no, p.expected, k.width) AS error
  FROM kw k JOIN kper p USING (file_id)
  WHERE (k.header_row IS NULL OR k.line_no > p.first_line) AND k.width <> p.expected
),
rfiles AS (
  SELECT p.file_id, p.executor, p.header_row, coalesce(k.n_kept, 0) AS n_kept, k.expected,
         coalesce(e.n_errors, 0) AS n_errors,
         coalesce(k.n_kept, 0) > 0 AND NOT (p.executor = 'whole_file' AND k.expected < 2) AND coalesce(e.n_errors, 0) = 0 AS applied
  FROM plan p LEFT JOIN kper k USING (file_id)
  LEFT JOIN (SELECT file_id, count(*) AS n_errors FROM rerr GROUP BY file_id) e USING (file_id)
),
rout AS (
  SELECT k.file_id,
    CAST(CASE WHEN k.header_row IS NULL THEN k.line_no + 1 ELSE k.line_no - k.header_row END AS BIGINT) AS line_no,
    CASE WHEN k.executor = 'row_level' THEN k.text
         WHEN k.header_row IS NOT NULL AND k.line_no = p.first_line
           THEN {_csvjoin(f"list_transform(fields, lambda x: regexp_replace(x, '{inv}', '', 'g'))", "','")}
         ELSE {_csvjoin("fields", "','")} END AS text
  FROM kw k JOIN kper p USING (file_id) JOIN rfiles r USING (file_id) WHERE r.applied
  UNION ALL
  SELECT file_id, CAST(1 AS BIGINT), array_to_string(list_transform(range(expected), lambda i: CAST(i AS VARCHAR)), ',')
  FROM rfiles WHERE applied AND header_row IS NULL
),
vout AS (
  SELECT file_id, count(*) AS n_lines,
         CAST(arg_min(length(text) - length(replace(text, ',', '')) + 1, line_no) AS BIGINT) AS header_width,
         arg_min(text, line_no) AS header_text,
         min(length(text) - length(replace(text, ',', '')) + 1) AS min_w,
         max(length(text) - length(replace(text, ',', '')) + 1) AS max_w
  FROM rout GROUP BY file_id
),
verified AS (
  SELECT file_id, n_lines, header_width,
         header_width >= 2 AND NOT regexp_matches(header_text, '{inv}') AND min_w = max_w AS verified
  FROM vout
)
"""


def with_repair(body: str, supplied: bool = False) -> str:
    return "WITH " + LINES.strip() + ",\n" + DETECT.strip() + ",\n" + repair_chain(supplied).strip() + ",\n" + body.strip()


def repair_oracles() -> dict[str, str]:
    q = {}
    cols = "SELECT file_id, delimiter, encoding, header_row, engine, n_row_repairs FROM prop"
    q["propose_params"] = with_repair(cols)
    q["merge_proposals"] = with_repair(cols, supplied=True)
    q["propose_single_column"] = with_repair("SELECT file_id, c AS single_column_delimiter FROM p10")
    q["validate_params"] = with_repair("SELECT file_id, valid, array_to_string(errs, '; ') AS errors FROM gatedq")
    q["review_report"] = with_repair(
        "SELECT file_id, primary_class, 'classes=' || array_to_string(cls, ',') || '; delimiter=' || coalesce(delimiter, '?')"
        " || '; header_row=' || coalesce(CAST(header_row AS VARCHAR), 'none') || '; row_repairs=' || CAST(n_row_repairs AS VARCHAR)"
        " AS summary FROM gatedq")
    q["approval_gate"] = with_repair("SELECT file_id, valid, approved, executor FROM gatedq")
    q["route_tier"] = with_detect(
        "SELECT file_id, CASE WHEN primary_class IS NOT NULL THEN 'csv' WHEN file_id % 2 = 0 THEN 'drift'"
        " ELSE 'healthy' END AS tier FROM classes")
    q["repair_rows"] = with_repair(
        "SELECT o.file_id, o.line_no, o.text FROM rout o JOIN gatedq g USING (file_id) WHERE g.executor = 'row_level'")
    q["repair_preamble"] = with_repair(
        "SELECT o.file_id, o.line_no, o.text FROM rout o JOIN gatedq g USING (file_id) WHERE g.header_row > 0")
    q["repair_whole_file"] = with_repair(
        "SELECT o.file_id, o.line_no, o.text FROM rout o JOIN gatedq g USING (file_id) WHERE g.executor = 'whole_file'")
    q["repair_errors"] = with_repair("SELECT file_id, CAST(row_number AS BIGINT) AS row_number, error FROM rerr")
    q["parse_repaired"] = with_repair(
        "SELECT file_id, count(*) - 1 AS n_rows, CAST(arg_min(len(string_split(text, ',')), line_no) AS BIGINT) AS n_cols"
        " FROM rout GROUP BY file_id")
    q["verify_widths"] = with_repair("SELECT file_id, n_lines, header_width, verified FROM verified")
    q["verify_missing_output"] = with_repair(
        "SELECT file_id, 'no_repaired_output_to_verify' AS error FROM rfiles WHERE file_id NOT IN (SELECT file_id FROM verified)")
    q["file_status"] = with_repair(
        "SELECT c.file_id, s.status, s.status = 'succeeded' AS success FROM classes c, LATERAL (SELECT CASE"
        " WHEN len(c.cls) = 0 THEN 'healthy'"
        " WHEN NOT g.valid THEN 'failed' WHEN NOT g.approved THEN 'rejected'"
        " WHEN NOT coalesce(r.applied, false) THEN 'failed' WHEN NOT coalesce(v.verified, false) THEN 'failed'"
        " ELSE 'succeeded' END AS status"
        " FROM (SELECT 1) one LEFT JOIN gatedq g ON g.file_id = c.file_id LEFT JOIN rfiles r ON r.file_id = c.file_id"
        " LEFT JOIN verified v ON v.file_id = c.file_id) s")
    q["write_canonical"] = with_repair("SELECT file_id, count(*) AS n_lines FROM rout GROUP BY file_id")
    return q


# Drift inputs and chain (S6, S7, C1-C23, D21), written directly in SQL.
INT = r"^\s*[+-]?\d+(?:_\d+)*\s*$"

DRIFT = rf"""
cells AS (
  SELECT 'customer' AS tbl, 1 AS ordinal, 'c_custkey' AS name, CAST(c_custkey AS VARCHAR) AS v FROM customer
  UNION ALL SELECT 'customer', 2, 'c_full_name', c_name FROM customer
  UNION ALL SELECT 'customer', 3, 'c_nationkey', 'N' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'customer', 4, 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer
  UNION ALL SELECT 'customer', 5, 'c_extra', 'x' || CAST(c_custkey % 7 AS VARCHAR) FROM customer
  UNION ALL SELECT 'orders', 1, 'o_orderstatus', o_orderstatus FROM orders
  UNION ALL SELECT 'orders', 2, 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'orders', 3, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'orders', 4, 'o_orderpriority', o_orderpriority FROM orders
  UNION ALL SELECT 'part', 1, 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'part', 2, 'p_name', p_name FROM part
  UNION ALL SELECT 'part', 3, 'p_size', CAST(CAST(p_size AS DOUBLE) AS VARCHAR) FROM part
  UNION ALL SELECT 'part', 4, 'p_brand', p_brand FROM part
),
cur AS (
  SELECT tbl, CAST(ordinal AS BIGINT) AS ordinal, name,
    CASE WHEN count(nullif(v, '')) = 0 THEN 'string'
         WHEN bool_and(nullif(v, '') IS NULL OR regexp_matches(v, '{INT}')) THEN 'int64'
         WHEN bool_and(nullif(v, '') IS NULL OR regexp_matches(v, '{FLOAT}')) THEN 'float64'
         WHEN bool_and(nullif(v, '') IS NULL OR lower(trim(v)) IN ('true', 'false')) THEN 'bool'
         ELSE 'string' END AS type,
    bool_or(nullif(v, '') IS NULL) AS nullable
  FROM cells GROUP BY tbl, ordinal, name
),
ball(tbl, version, ordinal, name, type) AS (VALUES
  ('customer', 1, 1, 'c_custkey', 'int64'), ('customer', 1, 2, 'c_name', 'string'),
  ('customer', 1, 3, 'c_nationkey', 'int64'), ('customer', 1, 4, 'c_acctbal', 'float64'),
  ('customer', 1, 5, 'c_mktsegment', 'string'),
  ('orders', 1, 1, 'o_orderkey', 'int64'), ('orders', 1, 2, 'o_custkey', 'int64'),
  ('orders', 1, 3, 'o_orderstatus', 'string'), ('orders', 1, 4, 'o_clerk', 'string'),
  ('orders', 2, 1, 'o_orderstatus', 'string'), ('orders', 2, 2, 'o_orderkey', 'int64'),
  ('orders', 2, 3, 'o_custkey', 'int64'), ('orders', 2, 4, 'o_orderpriority', 'string'),
  ('part', 1, 1, 'p_partkey', 'int64'), ('part', 1, 2, 'p_name', 'string'),
  ('part', 1, 3, 'p_size', 'int64'), ('part', 1, 4, 'p_brand', 'string')
),
base AS (
  SELECT b.tbl, CAST(b.version AS BIGINT) AS version, CAST(b.ordinal AS BIGINT) AS ordinal, b.name, lower(trim(b.type)) AS type
  FROM ball b WHERE b.version = (SELECT max(version) FROM ball x WHERE x.tbl = b.tbl)
),
diff AS (
  SELECT coalesce(c.tbl, b.tbl) AS tbl,
    CASE WHEN b.name IS NULL THEN 'added' WHEN c.name IS NULL THEN 'removed' ELSE 'type_changed' END AS kind,
    coalesce(c.name, b.name) AS col, b.type AS from_type, c.type AS to_type
  FROM cur c FULL OUTER JOIN base b ON c.tbl = b.tbl AND c.name = b.name
  WHERE b.name IS NULL OR c.name IS NULL OR b.type <> c.type
),
sets AS (
  SELECT t.tbl, count(d.kind) FILTER (WHERE d.kind = 'added') AS n_added,
    count(d.kind) FILTER (WHERE d.kind = 'removed') AS n_removed,
    count(d.kind) FILTER (WHERE d.kind = 'type_changed') AS n_type_changed,
    count(d.kind) > 0 AS has_changes
  FROM (SELECT DISTINCT tbl FROM cur) t LEFT JOIN diff d USING (tbl) GROUP BY t.tbl
),
pairs AS (
  SELECT row_number() OVER () AS pid, r.tbl, r.col AS a, a.col AS b
  FROM diff r JOIN diff a ON r.tbl = a.tbl AND r.kind = 'removed' AND a.kind = 'added'
),
m(pid, alo, ahi, blo, bhi, best) AS (
  SELECT pid, 0, len(a), 0, len(b),
    list_max(flatten(list_transform(range(0, len(a)), lambda i: list_transform(range(0, len(b)), lambda j:
      len(list_filter(range(1, least(len(a) - i, len(b) - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k))) * 1000000
      + (999 - i) * 1000 + (999 - j)))))
  FROM pairs
  UNION ALL
  SELECT c.pid, c.s.alo, c.s.ahi, c.s.blo, c.s.bhi,
    list_max(flatten(list_transform(range(c.s.alo, c.s.ahi), lambda i: list_transform(range(c.s.blo, c.s.bhi), lambda j:
      len(list_filter(range(1, least(c.s.ahi - i, c.s.bhi - j) + 1), lambda k: substr(p.a, i + 1, k) = substr(p.b, j + 1, k))) * 1000000
      + (999 - i) * 1000 + (999 - j)))))
  FROM (
    SELECT pid, unnest([
      {{'alo': alo, 'ahi': 999 - (best // 1000) % 1000, 'blo': blo, 'bhi': 999 - best % 1000}},
      {{'alo': 999 - (best // 1000) % 1000 + best // 1000000, 'ahi': ahi,
       'blo': 999 - best % 1000 + best // 1000000, 'bhi': bhi}}]) AS s
    FROM m WHERE best // 1000000 > 0
  ) c JOIN pairs p USING (pid)
  WHERE c.s.alo < c.s.ahi AND c.s.blo < c.s.bhi
),
sims AS (
  SELECT p.pid, p.tbl, p.a AS removed_column, p.b AS added_column,
         2.0 * coalesce(sum(m.best // 1000000), 0) / (len(p.a) + len(p.b)) AS similarity
  FROM pairs p LEFT JOIN m USING (pid) GROUP BY p.pid, p.tbl, p.a, p.b
),
cand AS (SELECT * FROM sims WHERE similarity >= 0.4),
hints(tbl, removed_column, added_column, similarity, used_r, used_a, n) AS (
  SELECT * FROM (SELECT tbl, removed_column, added_column, similarity, [removed_column], [added_column], 1 AS n
    FROM cand QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY similarity DESC, removed_column, added_column) = 1)
  UNION ALL
  SELECT * FROM (
    SELECT c.tbl, c.removed_column, c.added_column, c.similarity,
           list_append(h.used_r, c.removed_column), list_append(h.used_a, c.added_column), h.n + 1
    FROM (SELECT tbl, max(n) AS n FROM hints GROUP BY tbl) last JOIN hints h USING (tbl, n)
    JOIN cand c ON c.tbl = h.tbl
    WHERE NOT list_contains(h.used_r, c.removed_column) AND NOT list_contains(h.used_a, c.added_column)
    QUALIFY row_number() OVER (PARTITION BY c.tbl ORDER BY c.similarity DESC, c.removed_column, c.added_column) = 1)
),
conf AS (
  SELECT h.tbl, h.removed_column, h.added_column, h.similarity,
         h.similarity >= 0.6 AND r.from_type = a.to_type AS confirmed, 0.9 AS llm_confidence
  FROM hints h JOIN diff r ON r.tbl = h.tbl AND r.col = h.removed_column
  JOIN diff a ON a.tbl = h.tbl AND a.col = h.added_column
),
renames AS (
  SELECT tbl, removed_column, added_column, similarity,
         least(1.0, greatest(0.0, 0.4 * similarity + 0.6 * llm_confidence)) AS confidence
  FROM conf WHERE confirmed
),
ops0 AS (
  SELECT tbl, 0 AS grp, 'rename' AS op, added_column AS col, removed_column AS target_column,
         NULL::VARCHAR AS target_type, NULL::VARCHAR AS dflt, confidence FROM renames
  UNION ALL SELECT tbl, 1, 'cast', col, NULL, from_type, NULL, 1.0 FROM diff WHERE kind = 'type_changed'
  UNION ALL SELECT tbl, 2, 'add_default', col, NULL, from_type,
         CASE lower(trim(from_type)) WHEN 'string' THEN 'UNKNOWN' WHEN 'str' THEN 'UNKNOWN' WHEN 'object' THEN 'UNKNOWN'
              WHEN 'text' THEN 'UNKNOWN' WHEN 'int64' THEN '0' WHEN 'int' THEN '0' WHEN 'integer' THEN '0'
              WHEN 'float64' THEN '0.0' WHEN 'float' THEN '0.0' WHEN 'double' THEN '0.0'
              WHEN 'bool' THEN 'False' WHEN 'boolean' THEN 'False' END, 1.0
    FROM diff d WHERE kind = 'removed' AND NOT EXISTS (SELECT 1 FROM renames r WHERE r.tbl = d.tbl AND r.removed_column = d.col)
  UNION ALL SELECT tbl, 3, 'drop', col, NULL, NULL, NULL, 1.0
    FROM diff d WHERE kind = 'added' AND NOT EXISTS (SELECT 1 FROM renames r WHERE r.tbl = d.tbl AND r.added_column = d.col)
),
ops AS (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY grp, col) AS seq FROM ops0),
rejected AS (SELECT * FROM ops WHERE op = 'drop' AND contains(col, 'extra')),
kept AS (
  SELECT o.* FROM ops o WHERE NOT EXISTS (SELECT 1 FROM rejected r WHERE r.tbl = o.tbl AND r.op = o.op AND r.col = o.col
     AND r.target_column IS NOT DISTINCT FROM o.target_column AND r.target_type IS NOT DISTINCT FROM o.target_type)
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY
     CASE op WHEN 'assign_header' THEN -1 WHEN 'rename' THEN 0 WHEN 'cast' THEN 1 WHEN 'drop' THEN 2 ELSE 3 END, seq) AS exec_order
  FROM kept
),
presc AS (
  SELECT s.tbl, count(k.op) AS n_ops, coalesce(min(k.confidence), 1.0) AS confidence,
         count(k.op) > 0 AS valid, coalesce(min(k.confidence), 1.0) < 0.7 AS escalated
  FROM sets s LEFT JOIN kept k USING (tbl) WHERE s.has_changes GROUP BY s.tbl
)
"""


def with_drift(body: str) -> str:
    return "WITH RECURSIVE " + DRIFT.strip() + ",\n" + body.strip()


def drift_oracles() -> dict[str, str]:
    q = {}
    q["schema_inspect"] = with_drift('SELECT tbl AS "table", ordinal, name, type, nullable FROM cur')
    q["schema_baseline"] = with_drift('SELECT tbl AS "table", version, ordinal, name, type FROM base')
    q["schema_diff"] = with_drift('SELECT tbl AS "table", kind, col AS "column", from_type, to_type FROM diff')
    q["schema_sets"] = with_drift('SELECT tbl AS "table", n_added, n_removed, n_type_changed, has_changes FROM sets')
    q["rename_hints"] = with_drift(
        'SELECT tbl AS "table", removed_column, added_column, round(similarity, 4) AS similarity FROM hints')
    q["rename_blend"] = with_drift(
        'SELECT tbl AS "table", removed_column, added_column, round(confidence, 4) AS confidence FROM renames')
    cols = ('SELECT tbl AS "table", CAST(seq AS BIGINT) AS seq, op, col AS "column", target_column, target_type, '
            'dflt AS "default", round(confidence, 4) AS confidence FROM ')
    q["operations"] = with_drift(cols + "ops")
    q["operations_kept"] = with_drift(cols + "kept")
    q["operations_ordered"] = with_drift(
        'SELECT tbl AS "table", CAST(exec_order AS BIGINT) AS exec_order, op, col AS "column", true AS in_order, '
        "'' AS errors FROM ordered")
    q["escalation"] = with_drift(
        'SELECT tbl AS "table", n_ops, round(confidence, 4) AS confidence, valid, escalated, '
        "valid AND NOT escalated AS approved FROM presc")
    q["drift_review"] = with_drift(
        'SELECT tbl AS "table", string_agg(CASE kind WHEN \'type_changed\' THEN \'~ \' || col || \': \' || from_type || \' -> \' || to_type '
        "WHEN 'added' THEN '+ ' || col || ': ' || to_type ELSE '- ' || col END, chr(10) ORDER BY kind, col) AS review "
        "FROM diff GROUP BY tbl")
    return q


DRIFT_APPLY = rf"""
castchk AS (
  SELECT o.tbl, o.col AS "column", o.target_type,
    count(*) FILTER (WHERE c.v IS NOT NULL AND NOT coalesce(regexp_matches(c.v, '{FLOAT}')
        AND TRY_CAST(replace(trim(c.v), '_', '') AS DOUBLE) = floor(TRY_CAST(replace(trim(c.v), '_', '') AS DOUBLE)), false)) AS n_unparseable
  FROM ordered o JOIN presc p ON p.tbl = o.tbl AND p.valid AND NOT p.escalated
  JOIN cells c ON c.tbl = o.tbl AND c.name = o.col
  WHERE o.op = 'cast' AND o.target_type = 'int64'
  GROUP BY o.tbl, o.col, o.target_type
),
applied AS (
  SELECT p.tbl FROM presc p WHERE p.valid AND NOT p.escalated
    AND NOT EXISTS (SELECT 1 FROM castchk c WHERE c.tbl = p.tbl AND c.n_unparseable > 0)
),
outcols0 AS (
  SELECT c.tbl, c.ordinal AS pos, coalesce(r.target_column, c.name) AS name, coalesce(k.target_type, c.type) AS type
  FROM cur c JOIN applied a USING (tbl)
  LEFT JOIN ordered r ON r.tbl = c.tbl AND r.op = 'rename' AND r.col = c.name
  LEFT JOIN ordered k ON k.tbl = c.tbl AND k.op = 'cast' AND k.col = coalesce(r.target_column, c.name)
  WHERE NOT EXISTS (SELECT 1 FROM ordered d WHERE d.tbl = c.tbl AND d.op = 'drop' AND d.col = coalesce(r.target_column, c.name))
  UNION ALL
  SELECT o.tbl, 1000 + o.exec_order, o.col, o.target_type FROM ordered o JOIN applied USING (tbl) WHERE o.op = 'add_default'
),
outcols AS (SELECT tbl, CAST(row_number() OVER (PARTITION BY tbl ORDER BY pos) AS BIGINT) AS ordinal, name, type FROM outcols0),
verify AS (
  SELECT o.tbl, o.exec_order, o.op, o.col,
    CASE WHEN o.op IN ('rename', 'assign_header') AND c.name IS NOT NULL THEN 'column ' || o.col || ' still present'
         WHEN o.op IN ('rename', 'assign_header') AND t.name IS NULL THEN 'column ' || o.target_column || ' missing'
         WHEN o.op = 'cast' AND c.name IS NULL THEN 'column ' || o.col || ' missing'
         WHEN o.op = 'cast' AND c.type <> o.target_type THEN 'column ' || o.col || ' has type ' || c.type
         WHEN o.op = 'drop' AND c.name IS NOT NULL THEN 'column ' || o.col || ' still present'
         WHEN o.op = 'add_default' AND c.name IS NULL THEN 'column ' || o.col || ' missing' END AS error
  FROM ordered o JOIN applied a USING (tbl)
  LEFT JOIN outcols c ON c.tbl = o.tbl AND c.name = o.col
  LEFT JOIN outcols t ON t.tbl = o.tbl AND t.name = o.target_column
)
"""


def with_drift_apply(body: str) -> str:
    return "WITH RECURSIVE " + DRIFT.strip() + ",\n" + DRIFT_APPLY.strip() + ",\n" + body.strip()


def drift_apply_oracles() -> dict[str, str]:
    q = {}
    q["apply_operations"] = with_drift_apply('SELECT tbl AS "table", ordinal, name, type FROM outcols')
    q["cast_check"] = with_drift_apply('SELECT tbl AS "table", "column", target_type, n_unparseable FROM castchk')
    q["verify_operations"] = with_drift_apply(
        'SELECT tbl AS "table", CAST(exec_order AS BIGINT) AS exec_order, op, col AS "column", error FROM verify')
    q["drift_status"] = with_drift_apply(
        'SELECT s.tbl AS "table", CASE WHEN NOT s.has_changes THEN \'healthy\' WHEN NOT p.valid THEN \'invalid\' '
        "WHEN p.escalated THEN 'rejected' WHEN a.tbl IS NULL THEN 'failed' "
        "WHEN EXISTS (SELECT 1 FROM verify v WHERE v.tbl = s.tbl AND v.error IS NOT NULL) THEN 'failed' ELSE 'succeeded' END AS status, "
        "a.tbl IS NOT NULL AS applied, "
        "NOT s.has_changes OR (a.tbl IS NOT NULL AND NOT EXISTS (SELECT 1 FROM verify v WHERE v.tbl = s.tbl AND v.error IS NOT NULL)) AS success "
        "FROM sets s LEFT JOIN presc p USING (tbl) LEFT JOIN applied a USING (tbl)")
    hl = f"""
hf AS (
  SELECT file_id, unnest(range(1, len(string_split(raw, ',')) + 1)) AS ordinal, unnest(string_split(raw, ',')) AS value
  FROM lines WHERE line_no = 1
),
hb AS (SELECT ordinal, type FROM base WHERE tbl = 'orders'),
hchk AS (
  SELECT h.file_id, count(*) AS hw,
    bool_and(CASE WHEN b.type = 'int64' THEN regexp_matches(h.value, '{INT}')
                  WHEN b.type = 'float64' THEN regexp_matches(h.value, '{FLOAT}')
                  WHEN b.type = 'bool' THEN lower(trim(h.value)) IN ('true', 'false')
                  WHEN b.type IS NOT NULL THEN true ELSE false END) AS all_parse
  FROM hf h LEFT JOIN hb b USING (ordinal) GROUP BY h.file_id
),
hless AS (
  SELECT file_id, hw = (SELECT count(*) FROM hb) AND (SELECT bool_or(type <> 'string') FROM hb) AND all_parse AS headerless
  FROM hchk
)"""
    def wl(body):
        return "WITH RECURSIVE " + LINES.strip() + ",\n" + DRIFT.strip() + ",\n" + hl.strip() + ",\n" + body.strip()
    q["headerless_check"] = wl("SELECT file_id, headerless FROM hless")
    q["assign_header"] = wl(
        "SELECT l.file_id, (SELECT string_agg(name, ',' ORDER BY ordinal) FROM base WHERE tbl = 'orders') AS header, "
        "count(*) AS n_rows, 1.0 AS confidence FROM lines l JOIN hless h USING (file_id) WHERE h.headerless GROUP BY l.file_id")
    return q


# Log lines derived from events (S11); every 997th line is unparseable.
LOGS = r"""
logs AS (
  SELECT
    CASE WHEN bad THEN NULL ELSE event_id END AS event_id,
    CASE WHEN bad THEN NULL ELSE 'trace-' || CAST(user_id AS VARCHAR) END AS trace_id,
    CASE WHEN bad THEN NULL ELSE CASE event_type WHEN 'view' THEN 'propose' WHEN 'click' THEN 'validate'
         WHEN 'signup' THEN 'set_success' WHEN 'purchase' THEN 'set_rejected' WHEN 'error' THEN 'set_failure' END END AS node,
    CASE WHEN bad THEN NULL WHEN event_type = 'signup' THEN 'repair_completed' ELSE 'node_finished' END AS app_event,
    CASE WHEN bad THEN NULL ELSE 'csv_repair' END AS app_agent,
    CASE WHEN bad THEN NULL WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    CASE WHEN bad THEN NULL ELSE CASE event_type WHEN 'view' THEN 'wrong_delimiter' WHEN 'click' THEN 'header_detection'
         WHEN 'purchase' THEN 'mixed_delimiter' WHEN 'error' THEN 'engine_selection' END END AS failure_class,
    CASE WHEN bad THEN NULL ELSE 't' || CAST(user_id % 3 AS VARCHAR) END AS "table",
    CASE WHEN bad THEN NULL ELSE value END AS latency_ms,
    CASE WHEN bad THEN NULL ELSE ts END AS ts,
    bad AS parse_error
  FROM (SELECT *, event_id % 997 = 0 AS bad FROM events)
)
"""


def with_logs(body: str) -> str:
    return "WITH " + LOGS.strip() + ",\n" + body.strip()


AUDIT = r"""
aev AS (
  SELECT event_id, user_id, 'ep-' || CAST(user_id % 64 AS VARCHAR) AS episode_id,
    CASE event_type WHEN 'view' THEN 'propose' WHEN 'click' THEN 'validate' WHEN 'purchase' THEN 'human_approval'
         WHEN 'signup' THEN 'apply' WHEN 'error' THEN 'reverify' END AS node,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k, value AS latency_ms, ts AS created_ts
  FROM events
),
aev2 AS (
  SELECT *, CASE node WHEN 'propose' THEN 'proposed'
      WHEN 'validate' THEN CASE WHEN k % 2 = 0 THEN 'valid' ELSE 'invalid' END
      WHEN 'human_approval' THEN CASE WHEN k % 3 <> 0 THEN 'approved' ELSE 'rejected' END
      WHEN 'apply' THEN CASE WHEN k % 5 <> 0 THEN 'applied' ELSE 'apply_failed' END
      WHEN 'reverify' THEN CASE WHEN k % 7 <> 0 THEN 'verified' ELSE 'verification_failed' END END AS status
  FROM aev
),
eps AS (
  SELECT 'ep-' || CAST(c.file_id AS VARCHAR) AS episode_id, c.primary_class,
         (SELECT min(created_ts) FROM aev e WHERE e.episode_id = 'ep-' || CAST(c.file_id AS VARCHAR)) AS started_ts
  FROM classes c WHERE len(c.cls) > 0
)
"""


def with_audit(body: str) -> str:
    return "WITH " + LINES.strip() + ",\n" + DETECT.strip() + ",\n" + AUDIT.strip() + ",\n" + body.strip()


TSF = "'%Y-%m-%d %H:%M:%S.%f'"


def observe_oracles() -> dict[str, str]:
    q = {}
    q["log_ingest"] = with_logs(
        f"SELECT event_id, trace_id, node, app_event, app_agent, level, failure_class, \"table\", latency_ms, "
        f"strftime(ts, {TSF}) AS ts_text, strftime(ts, '%Y-%m-%d') AS log_date, parse_error FROM logs")
    q["volume_over_time"] = with_logs(
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(DISTINCT trace_id) AS n_traces "
        "FROM logs WHERE app_event = 'repair_completed' GROUP BY 1")
    q["class_distribution"] = with_logs(
        "SELECT failure_class, count(*) AS n FROM logs WHERE failure_class IS NOT NULL GROUP BY 1 "
        "ORDER BY n DESC, failure_class LIMIT 10")
    q["outcome_breakdown"] = with_logs(
        "SELECT node, count(*) AS n FROM logs WHERE node IN ('set_success', 'set_failure', 'set_rejected') GROUP BY 1 "
        "ORDER BY n DESC, node LIMIT 5")
    q["trace_explorer"] = with_logs(
        f"SELECT strftime(ts, {TSF}) AS ts_text, app_agent, node, app_event, level, \"table\", failure_class, latency_ms "
        "FROM logs WHERE trace_id = 'trace-7' ORDER BY ts, event_id")
    q["latency_summary"] = with_logs(
        "SELECT node, count(*) AS n, round(avg(latency_ms), 4) AS mean, round(stddev_samp(latency_ms), 4) AS stdev, "
        "list_sort(list(latency_ms))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95 "
        "FROM logs WHERE latency_ms IS NOT NULL AND node IS NOT NULL GROUP BY node")
    q["audit_events"] = with_audit(
        f"SELECT episode_id, event_id, node, status, latency_ms, strftime(created_ts, {TSF}) AS created_at FROM aev2")
    q["audit_payload"] = with_audit("SELECT event_id, node AS step, status, k FROM aev2")
    q["episode_state"] = with_audit(
        f"SELECT p.episode_id, coalesce(s.n_events, 0) AS n_events, s.last_node, s.last_status, "
        f"strftime(p.started_ts, {TSF}) AS started_at, strftime(s.last_ts, {TSF}) AS last_active_at, "
        "NOT coalesce(s.last_status IN ('verified', 'verification_failed', 'rejected', 'apply_failed', 'invalid'), false) AS is_active "
        "FROM eps p LEFT JOIN (SELECT episode_id, count(*) AS n_events, arg_max(node, (created_ts, event_id)) AS last_node, "
        "arg_max(status, (created_ts, event_id)) AS last_status, max(created_ts) AS last_ts FROM aev2 GROUP BY episode_id) s "
        "USING (episode_id)")
    q["episode_history"] = with_audit(
        f"SELECT episode_id, event_id, node, status, strftime(created_ts, {TSF}) AS created_at FROM aev2 "
        "WHERE episode_id = 'ep-1' ORDER BY created_ts, event_id")
    q["recent_episodes"] = with_audit(
        f"SELECT episode_id, primary_class, strftime(started_ts, {TSF}) AS started_at FROM eps "
        "ORDER BY started_ts DESC NULLS LAST, episode_id LIMIT 5")
    q["orphan_events"] = with_audit(
        "SELECT event_id, episode_id FROM aev2 WHERE episode_id NOT IN (SELECT episode_id FROM eps)")
    q["token_rollup"] = with_audit(
        "SELECT 'trace-' || CAST(user_id AS VARCHAR) AS trace_id, sum(k) AS input_tokens, "
        "sum(CAST(round(latency_ms) AS BIGINT)) AS output_tokens, sum(k + CAST(round(latency_ms) AS BIGINT)) AS total_tokens, "
        "round(sum(CASE WHEN node = 'human_approval' THEN latency_ms / 1000 END), 6) AS cost "
        "FROM aev2 WHERE node IN ('validate', 'human_approval') GROUP BY user_id")
    q["run_metrics"] = with_audit(
        "SELECT run_id, metric, round(value, 6) AS value FROM (SELECT episode_id AS run_id, "
        "unnest([{'metric': 'latency_ms', 'value': sum(latency_ms)}, "
        "{'metric': 'token_usage', 'value': CAST(sum(CASE WHEN node = 'validate' THEN k END) AS DOUBLE)}, "
        "{'metric': 'input_tokens', 'value': CASE WHEN sum(CASE WHEN node = 'validate' THEN k END) IS NULL THEN CAST(sum(k) AS DOUBLE) END}, "
        "{'metric': 'output_tokens', 'value': CASE WHEN sum(CASE WHEN node = 'validate' THEN k END) IS NULL THEN CAST(count(*) AS DOUBLE) END}, "
        "{'metric': 'total_tokens', 'value': CASE WHEN sum(CASE WHEN node = 'validate' THEN k END) IS NULL THEN CAST(sum(k) + count(*) AS DOUBLE) END}, "
        "{'metric': 'cost_usd', 'value': sum(CASE WHEN node = 'human_approval' THEN latency_ms / 1000 END)}], recursive := true) "
        "FROM aev2 GROUP BY episode_id) WHERE value IS NOT NULL")
    q["publish_uri"] = (
        "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]') THEN 'wasbs://' || regexp_extract(regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1), '^([^/]+)', 1) "
        "|| '@' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' || "
        "regexp_extract(regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1), '^[^/]+/?(.*)$', 1) END AS uri, "
        "CASE WHEN regexp_matches(url, '^https?://[^/?#]') THEN 'uri' ELSE 'no http address' END AS outcome FROM pages")
    return q


def status_oracles() -> dict[str, str]:
    st = ("SELECT c.file_id, CASE WHEN len(c.cls) = 0 THEN 'healthy' WHEN NOT g.valid THEN 'failed' "
          "WHEN NOT g.approved THEN 'rejected' WHEN NOT coalesce(r.applied, false) THEN 'failed' "
          "WHEN NOT coalesce(v.verified, false) THEN 'failed' ELSE 'succeeded' END AS status "
          "FROM classes c LEFT JOIN gatedq g USING (file_id) LEFT JOIN rfiles r USING (file_id) "
          "LEFT JOIN verified v USING (file_id)")
    q = {}
    q["run_status"] = with_repair(
        f"SELECT file_id, status, CASE status WHEN 'succeeded' THEN 'FINISHED' WHEN 'failed' THEN 'FAILED' "
        f"ELSE 'FINISHED' END AS run_status FROM ({st})")
    q["publish_selection"] = with_repair(
        f"SELECT file_id, CASE status WHEN 'healthy' THEN printf('source/file_%d.csv', file_id) "
        f"ELSE printf('repaired/file_%d.csv', file_id) END AS publish_path, status FROM ({st}) "
        "WHERE status IN ('healthy', 'succeeded')")
    q["migration_entries"] = with_drift(
        "SELECT p.tbl AS \"table\", 'mig-' || p.tbl AS episode_id, "
        "coalesce((SELECT max(version) FROM base b WHERE b.tbl = p.tbl), 0) AS baseline_version, p.n_ops, "
        "round(p.confidence, 4) AS confidence, CASE WHEN NOT p.valid THEN 'invalid' WHEN p.escalated THEN 'rejected' "
        "ELSE 'proposed' END AS status, coalesce((SELECT string_agg(CASE kind WHEN 'type_changed' THEN '~ ' || col || ': ' "
        "|| from_type || ' -> ' || to_type WHEN 'added' THEN '+ ' || col || ': ' || to_type ELSE '- ' || col END, chr(10) "
        "ORDER BY kind, col) FROM diff d WHERE d.tbl = p.tbl), '') AS diff FROM presc p")
    return q


def stream_oracles() -> dict[str, str]:
    """Streams are checked against the SQL of their batch equivalents."""
    det = detection_oracles()
    rep = repair_oracles()
    obs = observe_oracles()
    dr = drift_oracles()
    q = {
        "stream_detect": det["failure_classes"],
        "stream_repair": with_repair("SELECT file_id, line_no, text FROM rout"),
        "stream_logs": obs["log_ingest"],
        "stream_volume": obs["volume_over_time"],
        "stream_classes": obs["class_distribution"],
        "stream_outcomes": obs["outcome_breakdown"],
        "stream_refused": "SELECT 'no event time' AS reason, count(*) AS n FROM events WHERE event_id % 997 = 0",
        "volume_sketches": obs["volume_over_time"].replace("date_trunc('day', ts), '%Y-%m-%d') AS day", "ts, '%Y-%m') AS month")
        .replace("AS n_traces", "AS n_traces, true AS within_bound"),
        "stream_drift": dr["schema_diff"].replace(
            'SELECT tbl AS "table", kind, col AS "column", from_type, to_type FROM diff',
            'SELECT tbl AS "table", kind, col AS "column", from_type, to_type FROM diff WHERE tbl = \'customer\''),
        "stream_once": "SELECT DISTINCT o_custkey % 64 AS file_id, CAST(1 AS BIGINT) AS n_seen FROM orders",
    }
    _ = rep
    return q


# Well-formed UTF-8 byte sequences (Unicode standard, table 3-7), written
# over the code points 0-255 that stand for single bytes.
_UTF8_WELL_FORMED = (
    r"(?:[\x{00}-\x{7F}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]"
    r"|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]"
    r"|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2})*"
)


def encoding_oracles() -> dict[str, str]:
    """D1/D2 over the byte renderings of documents.text, computed on their
    characters: UTF-8 renderings are valid by construction; a Latin-1
    rendering has one byte per character, so its bytes are its code points."""
    q = {}
    q["encoding_evidence"] = (
        "WITH d AS (SELECT doc_id AS file_id, doc_id % 2 = 0 AS u8, CASE WHEN doc_id % 2 = 0 THEN text "
        r"ELSE regexp_replace(text, '[^\x{0000}-\x{00FF}]', '?', 'g') END AS t FROM documents), "
        "e AS (SELECT file_id, "
        f"CASE WHEN u8 THEN true ELSE regexp_full_match(t, '{_UTF8_WELL_FORMED}') END AS valid, "
        "CASE WHEN u8 THEN starts_with(t, chr(65279)) ELSE starts_with(t, chr(239) || chr(187) || chr(191)) END AS bom8, "
        "NOT u8 AND starts_with(t, chr(255) || chr(254)) AS bom_le, NOT u8 AND starts_with(t, chr(254) || chr(255)) AS bom_be, "
        "contains(t, chr(0)) AS nul, "
        r"NOT u8 AND regexp_matches(t, '[\x{80}-\x{9F}]') AS c1 FROM d), "
        "g AS (SELECT file_id, valid, CASE WHEN bom8 THEN 'utf-8-sig' WHEN bom_le THEN 'utf-16-le' "
        "WHEN bom_be THEN 'utf-16-be' WHEN nul THEN 'utf-16' WHEN valid THEN 'utf-8' WHEN c1 THEN 'cp1252' "
        "ELSE 'iso-8859-1' END AS encoding FROM e) "
        "SELECT file_id, encoding, CASE WHEN encoding IN ('utf-8-sig', 'utf-16-le', 'utf-16-be') THEN 1.0 "
        "WHEN encoding = 'utf-8' THEN 1.0 WHEN encoding = 'cp1252' THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, "
        "NOT valid AS wrong_encoding FROM g")
    # Files in six encodings (file_id % 6), semicolons in every second half dozen.
    files = "(SELECT DISTINCT doc_id // 128 AS file_id, (doc_id // 128) % 6 AS kind, (doc_id // 128) // 6 % 2 = 1 AS semicolon FROM documents)"
    name = "(['utf-8', 'iso-8859-1', 'cp1252', 'utf-8-sig', 'utf-16-le', 'utf-16-be'])[kind + 1]"
    wide = r"(SELECT doc_id // 128 AS file_id, bool_or(regexp_matches(text, '[\x{00A0}-\x{00FF}]')) AS latin FROM documents GROUP BY 1)"
    encoded = (f"WITH f AS (SELECT f.file_id, kind, semicolon, CASE WHEN kind = 1 AND NOT latin THEN 'utf-8' ELSE {name} END AS encoding "
               f"FROM {files} f JOIN {wide} w ON w.file_id = f.file_id), "
               "c AS (SELECT *, array_to_string(list_filter([CASE WHEN kind = 3 THEN 'invisible_characters' END, CASE WHEN semicolon THEN 'wrong_delimiter' END, "
               "CASE WHEN encoding NOT IN ('utf-8', 'utf-8-sig') THEN 'wrong_encoding' END], lambda x: x IS NOT NULL), ',') AS failure_classes FROM f) ")
    q["encoding_classes"] = (
        encoded + "SELECT file_id, encoding, failure_classes, CASE WHEN failure_classes = '' THEN NULL WHEN encoding = 'utf-8-sig' THEN 'utf-8' ELSE encoding END "
        "AS prescribed FROM c")
    q["encoding_repaired"] = (
        encoded + r", t AS (SELECT doc_id, n_chars, doc_id // 128 AS file_id, replace(replace(coalesce(text, ''), chr(10), '\n'), chr(13), '\r') AS t FROM documents), "
        r"l AS (SELECT *, regexp_replace(t, '[^\x{0000}-\x{00FF}]', '?', 'g') AS latin FROM t), "
        r"v AS (SELECT l.file_id, doc_id, n_chars, CASE kind WHEN 1 THEN regexp_replace(latin, '[\x{0080}-\x{009F}]', '?', 'g') WHEN 2 THEN latin || ' €' ELSE t END AS t "
        "FROM l JOIN f USING (file_id)), "
        "n AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY doc_id) + 1 AS line_no, doc_id || ',' || "
        "CASE WHEN contains(t, ',') OR contains(t, '\"') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END || ',' || n_chars AS text FROM v) "
        "SELECT file_id, line_no, text, true AS verified FROM (SELECT * FROM n UNION ALL SELECT file_id, 1, 'doc_id,name,n_chars' FROM f) "
        "WHERE file_id % 8 <> 7 AND file_id IN (SELECT file_id FROM c WHERE failure_classes <> '')")
    q["baselines_at_run"] = (
        "WITH c AS (SELECT p_brand, p_size, p_type AS name, (['int64', 'float64', 'string'])[count(*) % 3 + 1] AS type, count(*) > 1 AS nullable "
        "FROM part GROUP BY ALL), r AS (SELECT DISTINCT p_brand, p_partkey % 60 AS d FROM part), "
        "v AS (SELECT r.p_brand, d, max(p_size) AS p_size FROM r JOIN (SELECT DISTINCT p_brand, p_size FROM part) s "
        "ON s.p_brand = r.p_brand AND s.p_size <= d GROUP BY ALL) "
        "SELECT v.p_brand AS \"table\", strftime(DATE '2020-01-01' + d::INT, '%Y-%m-%d') AS run_at, v.p_size::INT AS version, "
        "row_number() OVER (PARTITION BY v.p_brand, d ORDER BY name)::INT AS ordinal, name, type, nullable "
        "FROM v JOIN c ON c.p_brand = v.p_brand AND c.p_size = v.p_size")
    q["source_unchanged"] = "SELECT DISTINCT o_custkey % 64 AS file_id, true AS unchanged FROM orders"
    return q
