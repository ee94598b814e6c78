"""DuckDB SQL equal to the registered queries, over the same whole tables."""

_FRAMES = """
frames AS (
  SELECT CAST(user_id AS VARCHAR) AS track_id, event_id AS source_index, epoch_us(ts) / 1e6 AS time,
         CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS text, least(value / 100.0, 1.0) AS confidence,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS nth
  FROM events
)"""

# the event types are far from each other, so two observations are one line only if their texts are equal
_WALK = f"""WITH RECURSIVE {_FRAMES},
walk AS (
  SELECT track_id, CAST(0 AS BIGINT) AS nth,
         CAST(NULL AS VARCHAR) AS cur, CAST(0 AS DOUBLE) AS cur_start, CAST(0 AS DOUBLE) AS cur_end, 0 AS cur_n, CAST(0 AS DOUBLE) AS cur_sum,
         CAST(NULL AS VARCHAR) AS pen, CAST(0 AS DOUBLE) AS pen_start, CAST(0 AS DOUBLE) AS pen_end, 0 AS pen_n, CAST(0 AS DOUBLE) AS pen_sum,
         0 AS blanks,
         CAST(NULL AS STRUCT(t VARCHAR, s DOUBLE, e DOUBLE, n INTEGER, c DOUBLE)) AS line,
         CAST(NULL AS STRUCT(t VARCHAR, s DOUBLE, e DOUBLE, n INTEGER, r VARCHAR)) AS rejected
  FROM (SELECT DISTINCT track_id FROM frames)
  UNION ALL
  SELECT track_id, nth,
    CASE WHEN closes OR promotes THEN (CASE WHEN promotes THEN f_text END) ELSE cur END,
    CASE WHEN promotes THEN new_start ELSE cur_start END,
    CASE WHEN joins OR promotes THEN f_time ELSE cur_end END,
    CASE WHEN promotes THEN new_n WHEN joins THEN cur_n + 1 ELSE cur_n END,
    CASE WHEN promotes THEN new_sum WHEN joins THEN cur_sum + f_conf ELSE cur_sum END,
    CASE WHEN closes OR joins OR promotes THEN NULL WHEN waits THEN f_text ELSE pen END,
    CASE WHEN waits THEN new_start ELSE pen_start END,
    CASE WHEN waits THEN f_time ELSE pen_end END,
    CASE WHEN waits THEN new_n ELSE pen_n END,
    CASE WHEN waits THEN new_sum ELSE pen_sum END,
    new_blanks,
    CASE WHEN (closes OR promotes) AND cur IS NOT NULL THEN struct_pack(t := cur, s := cur_start, e := cur_end, n := cur_n, c := cur_sum / cur_n) END,
    CASE WHEN pen IS NOT NULL AND (closes OR joins OR waits AND pen <> f_text)
         THEN struct_pack(t := pen, s := pen_start, e := pen_end, n := pen_n, r := CASE WHEN closes THEN 'blank_timeout' WHEN joins THEN 'ocr_jitter' ELSE 'unstable_pending' END) END
  FROM (
    SELECT w.*, f.nth AS f_nth, f.text AS f_text, f.time AS f_time, f.confidence AS f_conf,
      CASE WHEN f.text = '' THEN w.blanks + 1 WHEN f.confidence < 0.5 THEN w.blanks ELSE 0 END AS new_blanks,
      f.text = '' AND w.blanks + 1 > 2 AS closes,
      f.text <> '' AND f.confidence >= 0.5 AND w.cur IS NOT DISTINCT FROM f.text AS joins,
      f.text <> '' AND f.confidence >= 0.5 AND w.cur IS DISTINCT FROM f.text AS waits,
      CASE WHEN w.pen = f.text THEN w.pen_start ELSE f.time END AS new_start,
      CASE WHEN w.pen = f.text THEN w.pen_n + 1 ELSE 1 END AS new_n,
      CASE WHEN w.pen = f.text THEN w.pen_sum + f.confidence ELSE f.confidence END AS new_sum,
      f.text <> '' AND f.confidence >= 0.5 AND w.cur IS DISTINCT FROM f.text AND w.pen IS NOT DISTINCT FROM f.text AND w.pen_n + 1 >= 2 AS promotes
    FROM (SELECT * REPLACE (nth + 1 AS nth) FROM walk) w JOIN frames f ON f.track_id = w.track_id AND f.nth = w.nth
  )
),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY nth DESC) = 1),
lines AS (
  SELECT track_id, line.s AS start_time, line.e AS end_time, line.t AS text, line.n AS support_frames, line.c AS confidence FROM walk WHERE line IS NOT NULL
  UNION ALL SELECT track_id, cur_start, cur_end, cur, cur_n, cur_sum / cur_n FROM last WHERE cur IS NOT NULL
)"""

_TEXT = "regexp_replace(translate(text, '‘’ʼ', ''''''''), '\\s+', ' ', 'g')"
# the tables hold letters with accents, already composed; ß folds to ss
_MATCH = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[\\s]|[^\\PP&'']', '', 'g')"
_EVALUATE = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[\\s]|[^\\PP&''#]|[^\\PS+]', '', 'g')"
# edit distance is by bytes there: letters beyond ASCII get capitals, which match texts do not have
_BYTES = "translate({0}, 'àâäçèéêëîïíôöóùûüúñáœæ¿¡', 'ABCDEFGHIJKLMNOPQRSTUVWX')"

_SIDES = f"""
turns AS (SELECT CAST(conv_id AS VARCHAR) AS track_id, CAST(turn AS INTEGER) AS turn, text FROM conversations),
tracks AS (SELECT track_id, max(turn) AS last FROM turns GROUP BY track_id),
reference AS (
  SELECT track_id, 0 AS line_index, CAST(0 AS DOUBLE) AS timestamp, 'title ' || track_id AS text FROM tracks
  UNION ALL SELECT track_id, turn + 1, turn * 4.0 + 4, text FROM turns
),
candidate AS (
  SELECT track_id, turn AS line_index, CAST(turn * 4.0 + 4.5 + turn % 4 * 0.4 AS DOUBLE) AS timestamp, CASE WHEN turn % 2 = 1 THEN 'x' || text ELSE text END AS text FROM turns
  UNION ALL SELECT track_id, last + 1, last * 4.0 + 9, '~' FROM tracks
),
pairs AS (
  SELECT r.track_id, r.line_index AS reference_index, c.line_index AS candidate_index, r.text AS reference_text, c.text AS candidate_text, CAST(c.timestamp AS DOUBLE) - CAST(r.timestamp AS DOUBLE) AS raw_error,
         {_BYTES.format(_EVALUATE.format('r.text'))} AS a, {_BYTES.format(_EVALUATE.format('c.text'))} AS b
  FROM reference r JOIN candidate c ON r.track_id = c.track_id AND r.line_index = c.line_index + 1
)"""


def _clean(x: str) -> str:
    return f"CASE WHEN abs({x}) < 0.0000005 THEN 0.0 ELSE round({x}, 6) END"


_ACCURACY = f"""o AS (SELECT track_id, median(-raw_error) AS shift FROM pairs GROUP BY track_id),
m AS (SELECT p.*, o.shift, raw_error + o.shift AS residual, levenshtein(a, b) AS d FROM pairs p JOIN o ON p.track_id = o.track_id),
k AS (SELECT track_id, count(*) AS k, sum(d) AS edits, sum(length(a)) AS characters, count(*) FILTER (a <> b OR abs(residual) > 0.8) AS matched, any_value(shift) AS shift,
  median(raw_error) AS m1, median(abs(raw_error)) AS m2, quantile_cont(abs(raw_error), 0.9) AS m3, median(residual) AS m4, median(abs(residual)) AS m5, quantile_cont(abs(residual), 0.9) AS m6 FROM m GROUP BY track_id),
n AS (SELECT r.track_id, r.r, coalesce(c.c, 0) AS c FROM (SELECT track_id, count(*) AS r FROM reference GROUP BY 1) r LEFT JOIN (SELECT track_id, count(*) AS c FROM candidate GROUP BY 1) c ON r.track_id = c.track_id)
SELECT n.track_id, n.r AS reference_line_count, n.c AS candidate_line_count, coalesce(k, 0) AS matched_line_count, r - coalesce(k, 0) AS unmatched_reference_count, c - coalesce(k, 0) AS unmatched_candidate_count,
  {_clean('coalesce(k, 0) / r')} AS line_recall, CASE WHEN c > 0 THEN {_clean('coalesce(k, 0) / c')} ELSE 0.0 END AS line_precision, {_clean('CASE WHEN characters > 0 THEN edits / characters ELSE 0.0 END')} AS cer,
  {_clean('shift')} AS estimated_offset_s, {_clean(f'({_clean("shift")}) * 1000.0')} AS estimated_offset_ms,
  {_clean('m1')} AS raw_median_signed_s, {_clean('m2')} AS raw_median_abs_s, {_clean('m3')} AS raw_p90_abs_s, {_clean('m4')} AS residual_median_signed_s, {_clean('m5')} AS residual_median_abs_s, {_clean('m6')} AS residual_p90_abs_s,
  coalesce(matched, 0) + (r - coalesce(k, 0)) + (c - coalesce(k, 0)) AS manual_edit_count, {_clean('(coalesce(matched, 0) + (r - coalesce(k, 0)) + (c - coalesce(k, 0))) / r')} AS manual_edit_rate
FROM n LEFT JOIN k ON n.track_id = k.track_id"""

# the alignment's program: a cell is (score, matches, exact ones, displacement, gaps, pairs); a row of cells follows from the
# row before, first without its left neighbours (what skips the reference and what pairs, of each cell), then by a fold
_KEY = "row(round({0}.s, 12), {0}.k, {0}.x, -round({0}.d, 12), -{0}.g)"
_SKIPPED = "struct_pack(s := {0}.s - 0.35, k := {0}.k, x := {0}.x, d := {0}.d, g := {0}.g + 1, p := {0}.p)"
_CELL = "STRUCT(s DOUBLE, k BIGINT, x BIGINT, d DOUBLE, g BIGINT, p STRUCT(i BIGINT, j BIGINT)[])"
_ALIGNED = f"""{_SIDES},
lefts AS (SELECT track_id, list(a ORDER BY line_index) AS ra, list(line_index ORDER BY line_index) AS ri FROM (SELECT track_id, line_index, {_BYTES.format(_EVALUATE.format('text'))} AS a FROM reference) GROUP BY track_id),
rights AS (SELECT track_id, list(b ORDER BY line_index) AS cb, list(line_index ORDER BY line_index) AS ci FROM (SELECT track_id, line_index, {_BYTES.format(_EVALUATE.format('text'))} AS b FROM candidate) GROUP BY track_id),
tracks_of AS (SELECT *, len(ra) AS n, len(cb) AS m FROM lefts JOIN rights USING (track_id)),
program AS (
  SELECT track_id, CAST(0 AS BIGINT) AS i, list_transform(range(0, m + 1), lambda j: CAST(struct_pack(s := -0.35 * j, k := 0, x := 0, d := 0.0, g := j, p := []) AS {_CELL})) AS cells FROM tracks_of
  UNION ALL
  SELECT track_id, i, list_reduce(list_prepend([{_SKIPPED.format('cells[1]')}], options), lambda done, o: list_append(done,
    CASE WHEN o[2] IS NOT NULL AND {_KEY.format('o[2]')} >= {_KEY.format('o[1]')} AND {_KEY.format('o[2]')} >= {_KEY.format('l[1]').replace('l[1]', '(' + _SKIPPED.format('done[-1]') + ')')} THEN o[2]
         WHEN {_KEY.format('(' + _SKIPPED.format('done[-1]') + ')')} > {_KEY.format('o[1]')} THEN {_SKIPPED.format('done[-1]')} ELSE o[1] END)) AS cells
  FROM (
    SELECT track_id, i, cells, list_transform(range(1, m + 1), lambda j: [CAST({_SKIPPED.format('cells[j + 1]')} AS {_CELL}),
      CASE WHEN ra[i] <> '' AND cb[j] <> '' AND 1.0 - levenshtein(ra[i], cb[j]) / greatest(length(ra[i]), length(cb[j])) >= 0.55 THEN CAST(struct_pack(
        s := cells[j].s + (1.0 - levenshtein(ra[i], cb[j]) / greatest(length(ra[i]), length(cb[j]))), k := cells[j].k + 1, x := cells[j].x + CAST(ra[i] = cb[j] AS BIGINT),
        d := cells[j].d + abs((i - 0.5) / n - (j - 0.5) / m), g := cells[j].g, p := list_append(cells[j].p, struct_pack(i := i, j := j))) AS {_CELL}) END]) AS options
    FROM (SELECT q.track_id, q.i + 1 AS i, q.cells, t.* EXCLUDE (track_id) FROM program q JOIN tracks_of t ON q.track_id = t.track_id WHERE q.i < t.n)
  )
),
chosen AS (SELECT track_id, ra, cb, ri, ci, unnest(cells[-1].p) AS u FROM program JOIN tracks_of USING (track_id) WHERE i = n),
aligned AS (SELECT track_id, ri[u.i] AS reference_index, ci[u.j] AS candidate_index, 1.0 - levenshtein(ra[u.i], cb[u.j]) / greatest(length(ra[u.i]), length(cb[u.j])) AS similarity, CAST(levenshtein(ra[u.i], cb[u.j]) AS INTEGER) AS edit_distance, ra[u.i] AS a, cb[u.j] AS b FROM chosen)"""
_ALIGNED_PAIRS = "pairs AS (SELECT l.track_id, l.reference_index, l.candidate_index, CAST(c.timestamp AS DOUBLE) - CAST(r.timestamp AS DOUBLE) AS raw_error, l.a, l.b FROM aligned l JOIN reference r ON r.track_id = l.track_id AND r.line_index = l.reference_index JOIN candidate c ON c.track_id = l.track_id AND c.line_index = l.candidate_index)"

_PREPARED = f"""{_WALK},
scaled AS (
  SELECT track_id, text, support_frames, confidence, row_number() OVER (PARTITION BY track_id ORDER BY end_time, start_time) AS ordinal,
         round((start_time - min(start_time) OVER (PARTITION BY track_id)) / 10000, 3) AS start_raw, round((end_time - min(start_time) OVER (PARTITION BY track_id)) / 10000, 3) AS end_raw
  FROM lines
),
moved AS (
  SELECT *, greatest(0.0, start_raw + -500 / 1000.0) AS start_offset, start_raw + -500 / 1000.0 < 0 AS clamped FROM scaled
),
timed AS (SELECT *, CAST(round(CAST(CAST(start_offset AS VARCHAR) AS DECIMAL(38, 18)) * 100, 0) AS BIGINT) AS centiseconds FROM moved),
ordered AS (
  SELECT *, lag(centiseconds) OVER (PARTITION BY track_id ORDER BY ordinal) AS before,
         lag(centiseconds) OVER (PARTITION BY track_id ORDER BY centiseconds, ordinal) AS twin,
         row_number() OVER (PARTITION BY track_id ORDER BY centiseconds, ordinal) AS line_no
  FROM timed
),
prepared AS (
  SELECT *, array_to_string(list_filter([CASE WHEN clamped THEN 'negative_offset_clamped' END,
      CASE WHEN coalesce(centiseconds = before, FALSE) THEN 'duplicate_timestamp' END,
      CASE WHEN coalesce(centiseconds < before, FALSE) THEN 'out_of_order_timestamp' END,
      CASE WHEN coalesce(centiseconds = twin, FALSE) AND NOT coalesce(centiseconds = before, FALSE) THEN 'duplicate_timestamp' END], lambda x: x IS NOT NULL), ';') AS flags,
    format('{{:02d}}:{{:02d}}.{{:02d}}', centiseconds // 6000, centiseconds % 6000 // 100, centiseconds % 100) AS stamp
  FROM ordered
)"""

_BOX = """
boxes AS (
  SELECT l_orderkey, l_linenumber, CAST(l_partkey % 400 AS DOUBLE) AS x, CAST(l_suppkey % 8 * 15 AS DOUBLE) AS y, l_quantity + 1 AS w, 12.0 AS h,
         l_returnflag || CAST(l_linenumber AS VARCHAR) AS text, 1 - l_discount * 6 AS confidence
  FROM lineitem
)"""

_JOBS = """
jobs AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, CASE event_type WHEN 'view' THEN 'stage_started' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS type,
         ['prepare', 'extract', 'ocr', 'detector', 'writer'][event_id % 5 + 1] AS stage, value / 500 AS ratio,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events
)"""

_NOISY = f"""
t AS (SELECT CAST(conv_id AS VARCHAR) AS track_id, conv_id, turn, turn * 100.0 AS start, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS T, (conv_id + turn) % 4 AS which, conv_id % 2 = 1 AS apart FROM conversations),
noisy AS (SELECT *, length({_MATCH.format('T')}) + 1 AS n, 'ab' || turn AS ab, 'ac' || turn AS ac FROM t)"""


def _row(where: str, kind: str, reason: str, first: float, last: float, text: str, frames: int, confidence: str) -> str:
    return f"SELECT track_id, '{kind}' AS kind, {reason} AS reason, CAST(start + {first} AS DOUBLE) AS start_time, CAST(start + {last} AS DOUBLE) AS end_time, {text} AS text, CAST({frames} AS BIGINT) AS support_frames, round(CAST({confidence} AS DOUBLE), 6) AS confidence FROM noisy WHERE {where}"


# what must come of each kind of turn, one by one
_NOISY_ROWS = " UNION ALL ".join(
    _row(*r)
    for r in (
        ("which = 0", "line", "NULL", 0, 0.5, "T", 3, "(0.9 + 0.8 + 0.95) / 3"),
        ("which = 1 AND n >= 20", "line", "NULL", 0, 1.0, "T || 'q'", 3, "(0.9 + 0.8 + 0.85) / 3"),
        ("which = 1 AND n >= 20", "rejected", "'ocr_jitter'", 0.5, 0.75, "T || 'x'", 2, "0.95"),
        ("which = 1 AND n < 20", "line", "NULL", 0, 0.25, "T || 'q'", 2, "0.85"),
        ("which = 1 AND n < 20", "line", "NULL", 0.5, 0.75, "T || 'x'", 2, "0.95"),
        ("which = 1 AND n < 20", "rejected", "'blank_timeout'", 1.0, 1.0, "T || 'q'", 1, "0.85"),
        ("which = 2", "line", "NULL", 0, 1.0, "T", 3, "(0.9 + 0.9 + 0.7) / 3"),
        ("which = 2", "low_confidence", "'low_confidence'", 0.5, 0.5, "T", 1, "0.3"),
        ("which = 2", "rejected", "'ocr_jitter'", 0.75, 0.75, "'zz' || turn", 1, "0.9"),
        ("which = 3 AND NOT apart", "line", "NULL", 0, 0.5, "ab", 3, "(0.75 + 0.7 + 0.75) / 3"),
        ("which = 3 AND apart", "rejected", "'unstable_pending'", 0, 0, "ab", 1, "0.75"),
        ("which = 3 AND apart", "rejected", "'unstable_pending'", 0.25, 0.25, "ac", 1, "0.7"),
        ("which = 3 AND apart", "rejected", "'blank_timeout'", 0.5, 0.5, "ab", 1, "0.75"),
    )
)

ORACLES: dict[str, str] = {
    "noisy_lines": f"WITH {_NOISY} {_NOISY_ROWS}",
    "similar_neighbours": f"""WITH {_NOISY}, frames AS (SELECT *, unnest(range(CASE WHEN which IN (0, 3) THEN 6 ELSE 8 END)) AS k FROM noisy)
SELECT track_id, CAST(turn * 100 + k AS BIGINT) AS source_index, CASE WHEN k = 0 OR k >= (CASE WHEN which IN (0, 3) THEN 3 ELSE 5 END) THEN FALSE
  WHEN which = 0 THEN k = 2 OR n >= 10 WHEN which = 1 THEN k IN (1, 3) OR n >= 10 WHEN which = 2 THEN k <= 2 ELSE NOT apart END AS same
FROM frames WHERE k > 0 OR turn > (SELECT min(turn) FROM conversations c WHERE CAST(c.conv_id AS VARCHAR) = frames.track_id)""",
    "typed_lines": f"WITH {_NOISY} " + _row("TRUE", "line", "NULL", 0, 0.75, "T", 4, "(0.9 + 0.8 + 0.7 + 0.95) / 4"),
    "fragment_lines": f"""WITH {_NOISY.replace('noisy AS', 'plain AS')},
parts AS (SELECT *, string_split(T, ' ') AS w, list_transform(string_split(T, ' '), lambda x: {_MATCH.format('x')}) AS m FROM plain),
ends AS (SELECT *, list_transform(range(1, len(m) + 1), lambda i: length(array_to_string(m[1:i], ''))) AS c FROM parts),
noisy AS (SELECT track_id, start, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND m[i] <> '' AND c[i - 1] BETWEEN 2 AND c[-1] - 2 THEN ' ' ELSE '' END || w[i]), '') AS T FROM ends)
""" + _row("TRUE", "line", "NULL", 0, 0.25, "T", 2, "0.85"),
    "line_switches": f"{_WALK} SELECT track_id, start_time, end_time, text, CAST(support_frames AS BIGINT) AS support_frames, round(confidence, 6) AS confidence FROM lines",
    "rejected_clusters": f"""{_WALK}
SELECT track_id, rejected.r AS reason, rejected.s AS start_time, rejected.e AS end_time, rejected.t AS text, CAST(rejected.n AS BIGINT) AS support_frames FROM walk WHERE rejected IS NOT NULL
UNION ALL SELECT track_id, 'unconfirmed_eof', pen_start, pen_end, pen, pen_n FROM last WHERE pen IS NOT NULL""",
    "low_confidence_frames": f"WITH {_FRAMES} SELECT track_id, time AS start_time, text, round(confidence, 6) AS confidence FROM frames WHERE text <> '' AND confidence < 0.5",
    "short_gaps": f"""{_WALK}
SELECT track_id, start_time AS start_time_raw, text, coalesce((start_time - lag(start_time) OVER w) * 1000.0 < 86400000, FALSE) AS short_gap, FALSE AS similar FROM lines WINDOW w AS (PARTITION BY track_id ORDER BY start_time, end_time)""",
    "blank_intervals": f"""WITH {_FRAMES},
runs AS (SELECT *, sum(CASE WHEN text = '' THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY nth) AS run FROM frames)
SELECT track_id, min(time) AS start_time, max(time) AS end_time, count(*) AS frame_count, string_agg(CAST(source_index AS VARCHAR), ',' ORDER BY nth) AS frames FROM runs WHERE text = '' GROUP BY track_id, run""",
    "style_details": f"""WITH {_FRAMES},
sure AS (SELECT track_id, text, lag(text) OVER (PARTITION BY track_id ORDER BY nth) AS before FROM frames WHERE text <> '' AND confidence >= 0.5),
kinds AS (SELECT track_id, before, CASE WHEN before IS NULL THEN NULL WHEN before = text THEN 'exact' WHEN starts_with(text, before) THEN 'prefix'
  WHEN 100.0 * (1 - levenshtein(before, text) / greatest(length(before), length(text))) >= 90 THEN 'similar' ELSE 'changed' END AS kind FROM sure),
counts AS (SELECT track_id, count(*) AS non_empty_frames, count(kind) AS pair_count, count(*) FILTER (kind = 'exact') AS exact_pairs, count(*) FILTER (kind = 'similar') AS similar_pairs,
  count(*) FILTER (kind = 'prefix') AS prefix_extensions, count(*) FILTER (kind = 'changed') AS changed_pairs FROM kinds GROUP BY track_id)
SELECT *, CASE WHEN pair_count >= 2 AND prefix_extensions >= 2 AND prefix_extensions >= changed_pairs AND prefix_extensions / pair_count >= 0.25 THEN 'typewriter'
  WHEN pair_count >= 1 AND (exact_pairs + similar_pairs) / pair_count >= 0.40 THEN 'line' ELSE 'uncertain' END AS style_hint FROM counts""",
    "neighbour_same_line": f"""WITH {_FRAMES}, pairs AS (SELECT track_id, source_index, text AS b, lag(text) OVER (PARTITION BY track_id ORDER BY nth) AS a FROM frames)
SELECT track_id, source_index, a <> '' AND b <> '' AND (a = b OR greatest(length(a), length(b)) >= 5 AND least(length(a), length(b)) / greatest(length(a), length(b)) >= 0.70
  AND 100.0 * (1.0 - levenshtein(a, b) / greatest(length(a), length(b))) >= 90) AS same FROM pairs WHERE a IS NOT NULL""",
    "normalised_turns": f"SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS display_text, {_MATCH.format('text')} AS match_text, {_EVALUATE.format('text')} AS evaluation_text FROM conversations",
    "turn_similarity": f"""WITH base AS (SELECT conv_id, turn, {_BYTES.format(_MATCH.format('text'))} AS b FROM conversations),
pairs AS (SELECT *, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM base)
SELECT conv_id, turn, CAST(levenshtein(a, b) AS INTEGER) AS distance,
  CASE WHEN greatest(length(a), length(b)) = 0 THEN 100.0 ELSE round(100.0 * (1 - levenshtein(a, b) / greatest(length(a), length(b))), 6) END AS percent,
  CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) END AS similarity,
  CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END ELSE round(levenshtein(a, b) / length(a), 6) END AS cer
FROM pairs WHERE a IS NOT NULL""",
    "turn_medoids": f"""WITH m AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS display, {_BYTES.format(_MATCH.format('text'))} AS own FROM conversations),
members AS (SELECT * FROM m WHERE own <> ''),
faces AS (SELECT conv_id, display, min(turn) AS turn, any_value(own) AS own FROM members GROUP BY conv_id, display),
costs AS (SELECT f.conv_id, f.display, f.turn, f.own, CAST(sum(levenshtein(f.own, o.own)) AS BIGINT) AS cost FROM faces f JOIN members o ON f.conv_id = o.conv_id GROUP BY ALL)
SELECT conv_id, display AS medoid, cost AS total_distance FROM costs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, length(own) DESC, turn) = 1""",
    "boundary_votes": f"""WITH lines AS (SELECT text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY text),
parts AS (SELECT n, {_MATCH.format('text')} AS match_text, list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: {_MATCH.format('w')}) AS ws FROM lines),
kept AS (SELECT * FROM parts WHERE match_text <> ''),
size AS (SELECT match_text, CAST(sum(n) AS BIGINT) AS compatible_frames FROM kept GROUP BY match_text),
cuts AS (SELECT match_text, n, CAST(unnest(list_transform(range(1, len(ws)), lambda i: length(array_to_string(ws[1:i], '')))) AS INTEGER) AS position FROM kept WHERE len(ws) > 1 AND NOT list_contains(ws, '')),
votes AS (SELECT match_text, position, CAST(sum(n) AS BIGINT) AS votes FROM cuts GROUP BY match_text, position)
SELECT match_text, position, votes, compatible_frames, round(votes / compatible_frames, 6) AS ratio FROM votes JOIN size USING (match_text)
WHERE votes >= greatest(2, ceil(compatible_frames * 0.30)) AND position > 0 AND position < length(match_text)""",
    "box_geometry": f"WITH {_BOX} SELECT l_orderkey, l_linenumber, x AS x_min, x + w AS x_max, y AS y_min, y + h AS y_max, (x + (x + w)) / 2 AS x_center, (y + (y + h)) / 2 AS y_center, greatest(0.0, x + w - x) AS width, greatest(1e-6, y + h - y) AS height FROM boxes",
    "frame_status": f"""WITH {_BOX}, items AS (SELECT *, CASE WHEN l_linenumber IN (2, 3) THEN 0.0 ELSE confidence END AS sure FROM boxes WHERE l_linenumber <> 5),
counts AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (sure >= 0.5) AS good, string_agg(text, ',' ORDER BY l_linenumber, text) FILTER (sure >= 0.5) AS texts FROM items GROUP BY l_orderkey)
SELECT l_orderkey, CAST(coalesce(n, 0) AS INTEGER) AS n_raw, CAST(coalesce(good, 0) AS INTEGER) AS n_kept, CAST(coalesce(n - good, 0) AS INTEGER) AS n_rejected, coalesce(texts, '') AS kept,
  CASE WHEN good > 0 THEN 'ok' WHEN n > 0 THEN 'low_confidence' ELSE 'empty' END AS status FROM (SELECT DISTINCT l_orderkey FROM boxes) LEFT JOIN counts USING (l_orderkey)""",
    # tops are equal or 15 apart, beyond the reach of a box of 12, so a row is what shares a top
    "active_rows": f"""WITH {_BOX}, kept AS (SELECT *, greatest(1.0, w) AS share FROM boxes WHERE confidence >= 0.5),
found AS (SELECT l_orderkey, y, min(x) AS x0, max(x + w) - min(x) AS width, string_agg(text, ' ' ORDER BY x, l_linenumber, text) AS text, sum(confidence * share ORDER BY x, l_linenumber, text) / sum(share ORDER BY x, l_linenumber, text) AS sure FROM kept GROUP BY l_orderkey, y),
best AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM found QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY greatest(1.0, width) * (0.5 + sure / 2) DESC, sure DESC, length(text) DESC, y, x0) = 1)
SELECT l_orderkey, CAST(coalesce(n, 0) AS INTEGER) AS n_rows, coalesce(text, '') AS text, round(coalesce(sure, 0.0), 6) AS confidence, CASE WHEN n > 0 THEN 'ok' ELSE 'low_confidence' END AS status FROM (SELECT DISTINCT l_orderkey FROM boxes) LEFT JOIN best USING (l_orderkey)""",
    "adapted_results": """SELECT p_partkey, 1 AS n_items, trim(p_name) AS text, [0.9, 0.5, 0.25][p_partkey % 3 + 1] AS confidence, [2, 2, 0][p_partkey % 3 + 1] AS n_points FROM part""",
    "timestamps": """WITH s AS (SELECT l_orderkey, l_linenumber, greatest(0, CAST(round(CAST(CAST(l_extendedprice / 10.0 - 50.0 AS VARCHAR) AS DECIMAL(38, 18)) * 100, 0) AS BIGINT)) AS centiseconds FROM lineitem)
SELECT *, format('{:02d}:{:02d}.{:02d}', centiseconds // 6000, centiseconds % 6000 // 100, centiseconds % 100) AS stamp FROM s""",
    "frame_times": """WITH n AS (SELECT o_orderkey % 999999 + 1 AS frame_number FROM orders), f AS (SELECT frame_number, (frame_number - 1) * 1001 AS a, gcd((frame_number - 1) * 1001, 30000) AS g FROM n)
SELECT format('{:06d}.png', frame_number) AS frame, CAST(frame_number AS INTEGER) AS frame_number, round(a / 30000, 9) AS time,
  CASE WHEN g = 30000 THEN CAST(a // 30000 AS VARCHAR) ELSE CAST(a // g AS VARCHAR) || '/' || CAST(30000 // g AS VARCHAR) END AS time_fraction FROM f""",
    "regions": """WITH s AS (SELECT p_partkey, p_size, CAST(printf('%.2f', p_size / 100.0) AS DOUBLE) AS x, CAST(printf('%.2f', p_size / 100.0) AS DOUBLE) AS y, p_size + 700 AS high FROM part),
e AS (SELECT *, CAST(least(1919, floor(x * 1920 + 0.5)) AS INTEGER) AS l, CAST(least(1079, floor(y * 1080 + 0.5)) AS INTEGER) AS t, CAST(least(high - 1, floor(0.6 * high + 0.5)) AS INTEGER) AS bt FROM s),
r AS (SELECT *, CAST(least(1920, greatest(l + 1, floor((x + 0.5) * 1920 + 0.5))) AS INTEGER) - l AS w, CAST(least(1080, greatest(t + 1, floor((y + 0.25) * 1080 + 0.5))) AS INTEGER) - t AS h FROM e)
SELECT p_partkey, l AS x, t AS y, w AS width, h AS height, bt AS bottom_y, CAST(high - bt AS INTEGER) AS bottom_height, format('setpts=PTS-STARTPTS,crop={}:{}:{}:{},fps=4', w, h, l, t) AS filter FROM r""",
    "sample_times": "SELECT p_partkey, CAST(nth AS INTEGER) AS nth, round(p_retailprice * 0.05 + p_retailprice * 0.90 * nth / 5, 6) AS time FROM part, range(6) AS r(nth)",
    "probes": """SELECT p_partkey, 2 AS stream_index, 'h264' AS codec_name, CASE WHEN p_partkey % 3 = 0 THEN 1080 ELSE p_size + 100 END AS display_width, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE 1080 END AS display_height,
[270, 180, 0][p_partkey % 3 + 1] AS rotation, CASE WHEN p_partkey % 2 = 0 THEN CAST(printf('%.2f', p_retailprice) AS DOUBLE) ELSE 99.5 END AS duration, CASE WHEN p_partkey % 2 = 0 THEN 'stream' ELSE 'format' END AS duration_source,
1.25 AS start_time, 'format' AS start_time_source, round(30000 / 1001, 6) AS average_frame_rate FROM part""",
    "index_problems": """WITH i AS (SELECT format('{:06d}.png', s_suppkey) AS frame, s_acctbal FROM supplier), f AS (SELECT DISTINCT format('{:06d}.png', p_partkey) AS frame FROM part)
SELECT 'duplicate' AS problem, frame FROM i GROUP BY frame HAVING count(*) > 1 UNION ALL SELECT 'time', frame FROM i WHERE s_acctbal < 0
UNION ALL SELECT 'missing file', frame FROM (SELECT frame FROM i EXCEPT SELECT frame FROM f) UNION ALL SELECT 'not listed', frame FROM (SELECT frame FROM f EXCEPT SELECT frame FROM i)""",
    "prepared_lines": f"{_PREPARED} SELECT track_id, CAST(line_no AS INTEGER) AS line_no, centiseconds, text, flags FROM prepared",
    "lrc_texts": f"{_PREPARED} SELECT track_id, string_agg('[' || stamp || ']' || text, chr(10) ORDER BY line_no) || chr(10) AS content FROM prepared GROUP BY track_id",
    "review_rows": f"{_PREPARED} SELECT track_id, CAST(line_no AS INTEGER) AS line_no, printf('%.3f', start_raw) AS start_raw, printf('%.3f', start_offset) AS start_final, printf('%.3f', end_raw) AS end, text, CAST(support_frames AS VARCHAR) AS support_frames, flags AS qa_flags FROM prepared",
    "parsed_lrc": """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS track_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 3 AS source_line, conv_id FROM conversations),
s AS (SELECT track_id, text, source_line, 0 AS nth, turn * 60.0 + conv_id % 60 + (turn * 7 % 100) / 100 - 0.25 AS ts FROM t UNION ALL SELECT track_id, text, source_line, 1, (turn + 60) * 60.0 + turn + 0.5 - 0.25 FROM t)
SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY greatest(0.0, round(ts, 6)), source_line, nth) - 1 AS INTEGER) AS line_index, round(greatest(0.0, ts), 6) AS timestamp, text, CAST(source_line AS INTEGER) AS source_line FROM s WHERE text <> ''""",
    "accuracy": f"WITH {_SIDES}, {_ACCURACY}",
    "alignments": f"WITH RECURSIVE {_ALIGNED} SELECT track_id, reference_index, candidate_index, round(similarity, 6) AS similarity, edit_distance FROM aligned",
    "evaluation": f"WITH RECURSIVE {_ALIGNED.replace('pairs AS', 'fixed AS')}, {_ALIGNED_PAIRS}, {_ACCURACY}",
    "unmatched_references": f"WITH {_SIDES} SELECT track_id, line_index, text FROM reference r WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.track_id = r.track_id AND p.reference_index = r.line_index)",
    "similarity_matrix": f"""WITH {_SIDES}, every AS (SELECT r.track_id, r.line_index AS reference_index, c.line_index AS candidate_index, {_BYTES.format(_EVALUATE.format('r.text'))} AS a, {_BYTES.format(_EVALUATE.format('c.text'))} AS b FROM reference r JOIN candidate c ON r.track_id = c.track_id)
SELECT track_id, reference_index, candidate_index, CAST(levenshtein(a, b) AS INTEGER) AS edit_distance, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) END AS similarity FROM every""",
    "event_lines": f"WITH {_JOBS} SELECT job_id, seq, 'JOB_EVENT ' AS prefix, type, stage FROM jobs",
    "parsed_events": """SELECT event_id, CASE WHEN event_id % 7 >= 4 THEN event_type END AS type, ['no JSON', 'no object', 'no type', 'conflicting types', NULL, NULL, NULL][event_id % 7 + 1] AS issue FROM events WHERE event_id % 11 <> 0""",
    "parsed_chunks": """WITH lines AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_id % 5 <> 0)
SELECT job_id, nth, CASE WHEN event_id % 17 <> 0 THEN event_type END AS type, CASE WHEN event_id % 17 <> 0 THEN event_id || '-é' END AS message, CASE WHEN event_id % 17 = 0 THEN 'too long' END AS issue FROM lines""",
    "job_outcomes": f"""WITH {_JOBS}, ends AS (SELECT job_id, CAST(job_id AS BIGINT) AS j, arg_min(type, seq) AS terminal_type, CAST(min(seq) AS INTEGER) AS terminal_seq FROM jobs WHERE type IN ('completed', 'cancelled', 'failed') GROUP BY job_id)
SELECT job_id, terminal_type, terminal_seq, CASE WHEN terminal_type = 'completed' AND j % 13 <> 0 AND j % 7 <> 0 AND j % 5 <> 0 THEN 'succeeded'
  WHEN terminal_type = 'cancelled' OR j % 13 = 0 OR j % 11 = 0 AND terminal_type <> 'completed' THEN 'cancelled' ELSE 'failed' END AS outcome FROM ends""",
    "runner_states": """WITH RECURSIVE signals AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id AS n,
    CASE WHEN event_type = 'view' THEN 'start' WHEN event_type = 'signup' THEN 'started' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'cancel' WHEN event_type = 'error' THEN 'exit' ELSE 'event' END AS signal,
    CASE WHEN event_type = 'purchase' THEN ['cancelled', 'failed', 'completed', 'completed', 'completed'][event_id % 5 + 1] END AS ended, event_type = 'purchase' AND event_id % 4 <> 0 AS result, event_type = 'purchase' AND event_id % 5 = 1 AS wrong,
    [0, 0, 1, 130][event_id % 4 + 1] AS code, event_id % 7 = 0 AS crashed FROM events
), walk AS (
  SELECT job_id, CAST(0 AS BIGINT) AS seq, 'idle' AS state, 0 AS run, CAST(NULL AS VARCHAR) AS e, FALSE AS r, FALSE AS bad, FALSE AS accepted FROM (SELECT DISTINCT job_id FROM signals)
  UNION ALL
  SELECT w.job_id, w.seq,
    CASE WHEN NOT go THEN state WHEN signal = 'start' THEN 'starting' WHEN signal = 'started' AND state = 'starting' THEN 'running' WHEN signal = 'cancel' THEN 'cancelling' WHEN signal <> 'exit' THEN state
      WHEN NOT crashed AND code = 0 AND e = 'completed' AND r AND NOT bad THEN 'succeeded' WHEN coalesce(e = 'cancelled', FALSE) OR code = 130 OR state = 'cancelling' AND e IS DISTINCT FROM 'completed' THEN 'cancelled' ELSE 'failed' END,
    run + CAST(go AND signal = 'start' AS INTEGER),
    CASE WHEN go AND signal = 'start' THEN NULL WHEN go THEN coalesce(ended, e) ELSE e END, CASE WHEN go AND signal = 'start' THEN FALSE ELSE r OR go AND result END, CASE WHEN go AND signal = 'start' THEN FALSE ELSE bad OR go AND wrong END, go
  FROM (SELECT w.* REPLACE (w.seq + 1 AS seq), s.signal, s.ended, s.result, s.wrong, s.code, s.crashed, (s.signal = 'start') <> (w.state IN ('starting', 'running', 'cancelling')) AS go FROM walk w JOIN signals s ON s.job_id = w.job_id AND s.seq = w.seq + 1) w
)
SELECT job_id, seq, run, state, accepted FROM walk WHERE seq > 0""",
    "progress": f"""WITH {_JOBS}, b AS (SELECT *, [0, 8, 30, 90, 96][event_id % 5 + 1] AS low, [8, 30, 90, 96, 100][event_id % 5 + 1] AS high, CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE least(1.0, event_id % 83 / (event_id % 7 * 10)) END AS share FROM jobs)
SELECT job_id, event_id, CAST(CASE type WHEN 'stage_started' THEN low WHEN 'stage_completed' THEN high WHEN 'progress' THEN round_even(low + (high - low) * greatest(0.0, least(1.0, ratio)), 0) END AS INTEGER) AS overall, round(share, 9) AS ratio, round(share * 100, 2) AS percent FROM b""",
    "failed_frames": "SELECT CAST(user_id AS VARCHAR) AS track_id, format('{:06d}.png', event_id) AS frame, epoch_us(ts) / 1e6 AS time, 'no image' AS error FROM events WHERE event_type = 'error'",
    "recognition_check": """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS track_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS usable FROM events GROUP BY user_id)
SELECT *, CASE WHEN failed = total THEN 'every frame failed' WHEN usable = 0 THEN 'no usable text' END AS problem FROM f""",
    "cleaned_numbers": """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN NULL ELSE l_quantity * 3 - 10 END AS v, l_discount / 3 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, CASE WHEN v IS NULL THEN 1.0 WHEN v > 1 AND v <= 100 THEN v / 100 ELSE v END)) AS observed, coalesce(v, 0.0) AS recognised, CASE WHEN abs(d) < 0.0000005 THEN 0.0 ELSE round(d, 6) END AS cleaned FROM r""",
}
