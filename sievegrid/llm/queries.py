"""The queries opN_<name> over the driver's tables, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm import licenses, secrets, url_filters
from sievegrid.llm.licenses import PHRASES, TEMPLATES, license_scan
from sievegrid.llm.mixing import mix_sources
from sievegrid.llm.native import A_TO_Z, let, words_of
from sievegrid.llm.near_dup import near_duplicates
from sievegrid.llm.ordinal import fit_toxicity, score_toxicity
from sievegrid.llm.packing import pack
from sievegrid.llm.periodic import periodic_runs
from sievegrid.llm.quality_rules import quality_rules
from sievegrid.llm.secrets import BASE_KINDS, find_secrets
from sievegrid.llm.site_quality import fit_classifier, site_quality
from sievegrid.llm.spelling import letter_runs, variants, word_counts
from sievegrid.llm.training_order import materialise, read_slots
from sievegrid.llm.url_filters import url_filter
from sievegrid.llm.vptree import search
from sievegrid.session import discard, new_path, recording, stage, table

#: A file of ranks of a public byte-level tokenizer; a parameter, never a copy.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
Query = Callable[[SparkSession, str], DataFrame]


def tidied(query: Query) -> Query:
    """The query, after which only what its result reads stays of what it staged."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with recording() as paths:
            result = query(spark, sf_dir)
        read = {part for f in result.inputFiles() for part in f.split("/")}
        discard(spark, [p for p in paths if p.rpartition("/")[2] not in read])
        return result

    return run


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards, reads them back: a row a sequence, with its place and a digest of its tokens."""
    path = new_path(spark, "training-order")
    if not materialise(table(spark, sf_dir, "documents"), path, RANKS):
        return spark.createDataFrame([], "doc_id long, seq int, slot long, shard int, place long, n_tokens int, tokens_hash long")
    return read_slots(spark, path).select(F.col("id").alias("doc_id"), "seq", "slot", "shard", "place", "n_tokens", F.xxhash64("tokens").alias("tokens_hash"))


#: (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


@tidied
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 clean, 1 toxic, 2 toxic and of low quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, F.col("toxic") * (2 - F.coalesce("quality", F.lit(1))), 3)
    return score_toxicity(docs, model)


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no urls; their source stands for the host, source and language for the path."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return site_quality(docs, fit_classifier(docs, labels, F.col("quality")), F.col("source"), F.col("lang"))


@tidied
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix_sources(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), RANKS)
    return packed.withColumn("tokens_hash", F.xxhash64("tokens")).drop("tokens")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a tenth of the ids, chosen by checksum, are made periodic from some word on before the scan."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    g = F.floor(F.col("h") / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, a + F.pmod(i - a, p))).otherwise(w)), " ")

    planted = F.when(F.col("h") % 10 == 0, let(words_of(F.col("text")), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))).otherwise(F.col("text"))
    found = periodic_runs(docs.select("doc_id", planted.alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@tidied
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run in 199, chosen by checksum, loses a letter before words are counted."""
    runs = letter_runs(table(spark, sf_dir, "documents")).withColumn("h", F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % 199 == 0, less).otherwise(F.col("run")).alias("word"))
    return variants(stage(word_counts(words), "word-counts"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.round("score", 6).alias("score"),
    )


QUERIES: dict[str, Query] = {
    "op1_training_order": op1_training_order,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_secrets": op3_secrets,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_neighbours": op7_neighbours,
    "op8_toxicity": op8_toxicity,
    "op9_site_quality": op9_site_quality,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_license_scan": op13_license_scan,
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secrets_sql() -> str:
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "account": secrets.ACCOUNT, "endpoint": secrets.ENDPOINT, "candidate": secrets.CANDIDATE}
    value = _quoted(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""")
    parts = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {i} AS rank, string_split_regex(t, {_quoted(p)}) AS gaps, regexp_extract_all(t, {_quoted(p)}, 0) AS found FROM d" for i, (k, p) in enumerate(patterns.items()))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), raw AS ({parts}),
 placed AS (SELECT r, kind, rank, found[k] AS m, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS s FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM raw)),
 parts AS (SELECT r, kind, rank, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM placed WHERE kind <> 'assign' OR length(regexp_extract(m, {value}, 1)) >= 12),
 near AS (SELECT w.r, w.kind, w.rank, w.s, w.e, p.kind AS k2, p.s >= w.e OR p.e <= w.s AS apart FROM parts w JOIN parts p ON p.r = w.r AND p.s < w.e + 200 AND p.e > w.s - 200 WHERE w.rank > 2),
 votes AS (SELECT r, kind, rank, s, e, bool_or(apart AND k2 = 'account') AS a, bool_or(apart AND k2 = 'endpoint') AS p, bool_or(apart AND k2 = 'access') AS x, bool_or(apart AND k2 IN ('assign', 'hex')) AS b, bool_or(apart AND k2 = 'candidate') AS c, bool_or(NOT apart AND k2 IN ('assign', 'access', 'hex')) AS covered FROM near GROUP BY ALL),
 spans AS (SELECT r, kind, rank, s, e FROM parts WHERE rank <= 2 UNION ALL SELECT r, kind, rank, s, e FROM votes WHERE NOT covered AND CASE kind WHEN 'candidate' THEN x OR (a AND p) WHEN 'account' THEN b OR (p AND c) ELSE b OR x OR (a AND c) END)
 SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (WHERE rank <= 2), '')) AS base_sha256, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e), '') AS spans
 FROM d LEFT JOIN spans USING (r) GROUP BY r, doc_id"""


def _urls_sql(steps: int = 400, damping: float = 0.85) -> str:
    """url_filter() with its default parameters: the sum over walks of up to so many steps, far more than its tolerance asks for."""
    upper = url_filters.A_TO_Z
    host = lambda url: f"translate(regexp_extract(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{upper}', '{upper.lower()}')"
    longest = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    choose = lambda pick: "CASE " + " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{pick(r)}'" for r in longest) + " END"

    def ranks(name: str, edges: str, mass: str) -> str:
        share = f"{name}_share AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM {edges})"
        walks = f"{name}_walks AS (SELECT 0 AS k, host, {mass}::DOUBLE AS rank FROM votes WHERE {mass} > 0 UNION ALL SELECT k + 1, dst, sum(rank * share) * {damping} FROM {name}_walks JOIN {name}_share ON host = src WHERE k < {steps} GROUP BY k, dst)"
        return f"{share}, {walks}, {name} AS MATERIALIZED (SELECT host, sum(rank) / sum(sum(rank)) OVER () AS {name} FROM {name}_walks GROUP BY 1)"

    return f"""WITH RECURSIVE u AS (SELECT page_id, coalesce(html, '') AS html, coalesce({host("url")}, '') AS host, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, html, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM u),
 j AS MATERIALIZED (SELECT page_id, host, path, {choose(lambda r: r[1] + r[2])} AS rule, {choose(lambda r: r[0])} AS ruled FROM p),
 l AS (SELECT host AS src, ':' || unnest(regexp_extract_all(html, {_quoted(url_filters.LINK)}, 1)) AS link FROM p), up AS (SELECT DISTINCT host AS src, regexp_replace(host, '^[^.]*\\.', '') AS dst FROM p WHERE len(string_split(host, '.')) > 2 AND regexp_replace(host, '^[^.]*\\.', '') NOT IN {url_filters.SUFFIXES}),
 e AS MATERIALIZED (SELECT src, dst, sum(w)::DOUBLE AS weight FROM (SELECT src, {host("link")} AS dst, 1 AS w FROM l UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2), back AS (SELECT dst AS src, src AS dst, weight FROM e),
 votes AS MATERIALIZED (SELECT host, count(*) FILTER (WHERE ruled = 'allow') AS allowed, count(*) FILTER (WHERE ruled = 'block') AS blocked FROM j GROUP BY 1),
 {ranks("trust", "e", "allowed")}, {ranks("distrust", "back", "blocked")}
 SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN j.host <> '' AND coalesce(distrust, 0) > coalesce(trust, 0) * (1 + {url_filters.EVEN}) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
 FROM j LEFT JOIN trust ON trust.host = j.host LEFT JOIN distrust ON distrust.host = j.host"""


#: The rules of quality_rules() with its default parameters.
QUALITY_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
 c AS (SELECT r, doc_id, lang, t, w, len(w) AS n_words, array_to_string(w, '') AS letters, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
 m AS (SELECT *, regexp_replace(letters, '\p{Ll}+', '', 'g') AS rare FROM c),
 k AS (SELECT r, doc_id, lang, n_words, length(letters) AS word_chars, length(rare) AS n_rare, length(regexp_replace(rare, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  length(regexp_replace(rare, '[^\p{Lu}]+', '', 'g')) AS upper_, length(regexp_replace(rare, '[^\p{Nd}]+', '', 'g')) AS digit, length(regexp_replace(regexp_replace(rare, '[#*$%&|<>]+', '', 'g'), '[^\p{P}]+', '', 'g')) AS mark FROM m),
 tri AS (SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 again AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
 rep AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
 short AS (SELECT r, lang, lower(x) AS word FROM (SELECT r, lang, unnest(w) AS x FROM w) WHERE length(x) <= 4),
 top AS (SELECT lang, word, count(*) AS n FROM short GROUP BY lang, word QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) <= 32),
 cells AS (SELECT r, lang, class, n::DOUBLE AS n FROM k, LATERAL (VALUES ('lower', word_chars - n_rare), ('upper', upper_), ('digit', digit), ('symbol', n_symbols), ('mark', mark), ('other', n_rare - upper_ - digit - n_symbols - mark)) v(class, n)),
 shares AS (SELECT r, coalesce(n / nullif(sum(n) OVER (PARTITION BY r), 0), 0) AS p, coalesce(sum(n) OVER (PARTITION BY lang, class) / nullif(sum(n) OVER (PARTITION BY lang), 0), 0) AS q FROM cells),
 cd AS (SELECT r, sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS class_distance FROM shares GROUP BY 1),
 ref AS (SELECT lang, sum(n_words) AS ref_words FROM k GROUP BY 1),
 grid AS (SELECT k.r, greatest(k.n_words, 1)::DOUBLE AS n, t.word, t.n / ref_words AS q FROM k JOIN ref USING (lang) JOIN top t USING (lang)),
 seen AS (SELECT r, word, count(*) AS s FROM short GROUP BY ALL),
 g2 AS (SELECT g.r, g.n, q, coalesce(s, 0) / g.n AS p, coalesce(s, 0) AS s FROM grid g LEFT JOIN seen ON seen.r = g.r AND seen.word = g.word),
 g3 AS (SELECT r, p, q FROM g2 UNION ALL SELECT r, (max(n) - sum(s)) / max(n), 1 - sum(q) FROM g2 GROUP BY r),
 wd AS (SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 0) / 2) AS word_distance FROM g3 GROUP BY 1),
 j AS (SELECT k.*, coalesce(n_repeat_words, 0) AS n_rep, n_words >= 50 AND ref_words >= 2000 AS judged, class_distance, word_distance FROM k JOIN ref USING (lang) LEFT JOIN rep USING (r) LEFT JOIN cd USING (r) LEFT JOIN wd USING (r)),
 f AS (SELECT *, n_words < 50 OR 100 * n_rep > 50 * n_words AS base_failed FROM j)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_rep AS n_repeat_words, base_failed, NOT base_failed AND (NOT judged OR coalesce(class_distance, 0) <= 0.33) AND (NOT judged OR coalesce(word_distance, 0) <= 0.48) AS kept,
 CASE WHEN judged THEN round(class_distance, 6) END AS class_distance, CASE WHEN judged THEN round(word_distance, 6) END AS word_distance FROM f"""


def _licenses_sql(least: float = 0.8) -> str:
    """license_scan() with its default parameters: every block against every template of its size."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', {licenses.block_size(t)}, {sorted(set(t.split()))})" for label, t in TEMPLATES)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{A_TO_Z}', '{A_TO_Z.lower()}'), {word}) AS w FROM documents),
 ph AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) v(p, label)), te AS (SELECT label, s, t, ceil(len(t) * {least} - 1e-9) AS need FROM (VALUES {templates}) v(label, s, t)),
 place AS (SELECT r, label, i - 1 AS start FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) x JOIN ph ON w[i] = p[1] AND w[i:i + len(p) - 1] = p),
 sizes AS (SELECT s, list_distinct(flatten(list(t))) AS own FROM te GROUP BY s),
 block AS (SELECT r, s, k, list_distinct(list_filter(w[k * s + 1:(k + 2) * s], lambda x: list_contains(own, x))) AS b FROM (SELECT r, w, s, own, unnest(range(0, (len(w) + s - 1) // s)) AS k FROM d, sizes)),
 hit AS (SELECT r, label, len(list_intersect(b, t)) / len(t) AS c FROM block JOIN te USING (s) WHERE len(b) >= need AND len(list_intersect(b, t)) >= need),
 base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM place GROUP BY r),
 every AS (SELECT r, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(c) AS c FROM (SELECT r, label, 1.0 AS c FROM place UNION ALL SELECT r, label, c FROM hit) GROUP BY r)
 SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(c, 0.0), 6) AS score FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)"""


def _spelling_sql() -> str:
    """The words' checksums from a table of remainders, near words by equal words less one place."""
    table_of = ", ".join(str(_remainder(i)) for i in range(256))
    letters = "[A-Za-z\u00C0-\u00FF]{6,}"
    return f"""WITH RECURSIVE crc AS (SELECT [{table_of}]::UBIGINT[] AS tab),
 runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{letters}')), '{A_TO_Z}', '{A_TO_Z.lower()}') AS run FROM documents) GROUP BY ALL),
 bytes AS (SELECT doc_id, run, c, hex(encode(doc_id || ':' || run)) AS x FROM runs),
 sums AS (SELECT run, c, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::UBIGINT), lambda a, b: xor(tab[((xor(a, b) & 255) + 1)::BIGINT], a >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM bytes, crc),
 edited AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:(h % len(run))::BIGINT] || run[(h % len(run))::BIGINT + 2:] ELSE run END AS word, c FROM sums),
 words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM edited WHERE len(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
 less AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
 near AS (SELECT DISTINCT * FROM (SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION ALL SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION ALL SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word)),
 best AS (SELECT word, n, count(*) AS n_near, (min((-m, other)))[2] AS form, max(m) AS form_n FROM near GROUP BY word, n),
 told AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * words.n THEN form END AS form, CASE WHEN form_n >= 5 * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
 chain AS (SELECT word, form AS root, 1 AS k FROM told WHERE form IS NOT NULL UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN told ON told.word = root WHERE form IS NOT NULL)
 SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM told LEFT JOIN (SELECT word, max_by(root, k) AS root FROM chain GROUP BY word) USING (word)"""


def _remainder(byte: int) -> int:
    """What CRC-32's reflected polynomial leaves of a byte."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


ORACLE: dict[str, str] = {"op3_secrets": _secrets_sql(), "op4_url_filter": _urls_sql(), "op6_quality_rules": QUALITY_SQL, "op12_spelling_variants": _spelling_sql(), "op13_license_scan": _licenses_sql()}
