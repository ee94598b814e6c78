"""The registered queries of this subpackage and their SQL.

Each query is thin: it applies an operator, with production parameters, to the
whole of its table and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.telephony import read_audio, store_text_audio

    read = read_audio(store_text_audio(table(spark, sf_dir, "documents")), keep_pcm=True)
    # the digest of the resampled audio is taken from the column that stores it
    return read.withColumns({"pcm_bytes": F.octet_length("pcm").cast("long"), "pcm_sha256": F.sha2("pcm", 256)}).drop("pcm", "error")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op3_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.mincut_html import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.url_filter import Rule, judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, [Rule(*r) for r in URL_RULES]).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), hits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT DISTINCT page_id, rule, verdict FROM hits WHERE place = 1) h ON p.page_id = h.page_id
"""


def op6_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.suffix_match import contamination, is_contaminated

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13)
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), is_contaminated().alias("contaminated"), *(F.col(f"longest.{c}").alias(f"longest_{c}") for c in ("words", "doc_word", "item", "item_word")))


def op7_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.line_crf import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines")


#: the key of runs whose session names none
PII_KEY = "verseline-surrogates-1"


def pii_key(spark: SparkSession) -> str:
    """The secret that surrogates are drawn with: the session's spark.verseline.pii.key."""
    return spark.conf.get("spark.verseline.pii.key", PII_KEY)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.pii_surrogates import replace_entities

    out = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_entities"), F.array_join("pii_kinds", ",").alias("kinds"))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.secrets import count_of, joined, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = {f"n_{k}": count_of("spans", k) for k in ("assign", "access", "hex")}
    return found.withColumns({**counts, "base_sha256": F.sha2(joined("spans", base_only=True), 256)}).withColumn("spans", joined("spans"))


def _found(kind: int, pattern: str, value: str = "m[i]", least: int = 1) -> str:
    """SQL for a pattern's matches: a match starts behind all the pieces and matches before it."""
    starts = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT rk, {kind} AS k, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(s := CAST({starts} AS INTEGER), e := CAST({starts} + length(m[i]) AS INTEGER), v := {value.format(pattern=pattern)}))) AS c, {least} AS least
  FROM (SELECT rk, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM texts)"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in word)


_KEYWORDS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
_KEY_MARK = "-----{} [A-Z ]{{0,40}}PRIVATE KEY-----"
_CANDIDATES = "\n  UNION ALL ".join(
    (
        _found(0, f"""(?:{_KEYWORDS})["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+""", f"""regexp_extract(m[i], '^(?:{_KEYWORDS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)""".replace("{", "{{").replace("}", "}}"), 6),
        _found(1, "AKIA[A-Z0-9]+", least=20),
        _found(2, "[0-9a-f]{24,}"),
        _found(3, _KEY_MARK.format("BEGIN") + "[A-Za-z0-9+/=\\x20\\t\\r\\n]*" + _KEY_MARK.format("END")),
        _found(4, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    )
)
_SPAN = "string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, k, e)"

OP9_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, row_number() OVER () AS rk FROM documents),
found AS ({_CANDIDATES}),
candidates AS (SELECT rk, k, c.s AS s, c.e AS e, c.v AS v FROM found WHERE length(c.v) >= least),
owners AS (SELECT v, count(DISTINCT owner) AS n FROM candidates JOIN texts USING (rk) GROUP BY v),
spans AS (SELECT rk, k, s, e FROM candidates UNION SELECT rk, CASE WHEN n <= 1 THEN 5 ELSE 6 END, s, e FROM candidates JOIN owners USING (v)),
named AS (SELECT *, ['assign', 'access', 'hex', 'key', 'jwt', 'live', 'example'][k + 1] AS name FROM spans),
rows AS (SELECT rk, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS h, {_SPAN} FILTER (k < 3) AS base, {_SPAN} AS every FROM named GROUP BY rk)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM texts LEFT JOIN rows USING (rk)
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""

_WORDS = "regexp_extract_all({0}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP6_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
cuts AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS ipos FROM items WHERE len(w) > 0),
bench AS (SELECT CAST(item_id AS VARCHAR) AS name, n, ipos, array_to_string(w[ipos:ipos + n - 1], ' ') AS win FROM cuts),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, w FROM docs, (SELECT DISTINCT n FROM bench) WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.pos, p.n, b.name, b.ipos FROM (SELECT doc_id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS win FROM places) p JOIN bench b ON b.n = p.n AND b.win = p.win),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, name FROM hits) GROUP BY doc_id),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, name, n, pos - ipos ORDER BY pos) AS run FROM hits),
matches AS (SELECT doc_id, name, CAST(count(*) + n - 1 AS BIGINT) AS words, min(pos) - 1 AS doc_word, min(ipos) - 1 AS item_word FROM runs GROUP BY doc_id, name, n, pos - ipos, run),
longest AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, doc_word, name, item_word) = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, m.words AS longest_words, m.doc_word AS longest_doc_word, m.name AS longest_item, m.item_word AS longest_item_word
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id LEFT JOIN longest m ON m.doc_id = d.doc_id
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verseline.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_telephony": op1_telephony,
        "op2_near_dedup": op2_near_dedup,
        "op3_mincut_html": op3_mincut_html,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_url_filter": op5_url_filter,
        "op6_suffix_decontamination": op6_suffix_decontamination,
        "op7_line_crf_quality": op7_line_crf_quality,
        "op8_pii_surrogates": op8_pii_surrogates,
        "op9_secret_ownership": op9_secret_ownership,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op5_url_filter": OP5_SQL, "op6_suffix_decontamination": OP6_SQL, "op9_secret_ownership": OP9_SQL}
