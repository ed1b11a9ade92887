"""Secret scan with multipart credential linking. Native: DataFrame functions only.

Three base kinds are found by pattern. Weaker parts - account identifiers, service endpoints and mixed-character
strings that could be secrets - mean nothing alone. They are interval-joined within a scope, the same text and at
most ``scope`` code points apart, and a weak part is reported only if complementary parts stand in its scope:
a weak secret beside an identifier and an endpoint or beside an access key, an identifier or an endpoint beside a secret.

Defined cases: a null text is empty; a document without findings gets empty lists; repeated rows get repeated
results (rows are told apart by a key of their own, so null and repeated ids are safe); an empty table gives an
empty one; no other column is read. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.llm.native import free_name, let, text_of
from sievegrid.session import stage, unstage

BASE_KINDS = ["assign", "access", "hex"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: For the last two, a longest run is a match, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts.
ACCOUNT = r"""(?i)(?:user|username|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
ENDPOINT = r"""(?i)(?:https?|ftps?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]{4,}"""
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SPAN = "array<struct<kind:string,start:int,end:int>>"


#: Matches to a block: places are summed inside blocks, then over blocks, so work stays near linear in the matches.
BLOCK = 64


def spans_of(text: Column, pattern: str, kind: str, fits: Callable[[Column], Column] | None = None) -> Column:
    """Spans of all matches, leftmost and non-overlapping, of those that fit. The text between matches gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    width = lambda x: x["gap"] + x["n"]
    zero = F.lit(0)

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        sizes = F.zip_with(gaps, matches, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n"), (fits(b) if fits else F.lit(True)).alias("fits")))

        def blocked(x: Column) -> Column:
            blocks = F.transform(F.sequence(zero, F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))
            return let(blocks, walked)

        def walked(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, y: a + width(y)))
            first = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("list"))
            starts = F.aggregate(totals, first, lambda a, t: F.struct((a["at"] + t).alias("at"), F.concat(a["list"], F.array(a["at"])).alias("list")), lambda a: a["list"])
            return F.flatten(F.zip_with(blocks, starts, spans_in))

        def spans_in(x: Column, start: Column) -> Column:
            def span(y: Column, j: Column) -> Column:
                begin = start + F.aggregate(F.slice(x, 1, j), zero, lambda a, z: a + width(z)) + y["gap"]
                return F.when(y["fits"], F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + y["n"]).alias("end")))

            return F.array_compact(F.transform(x, span))

        return let(sizes, blocked)

    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(placed(m)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """(id, base, weak, spans): arrays of (kind, start, end), each ordered by start, then kind as listed.

    ``weak`` has the kinds account, endpoint and candidate that complementary parts confirm; ``spans`` is both.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    scanned = base.select(
        "row",
        "id",
        spans_of(F.col("text"), ASSIGN, "assign", _long_enough).alias("assign"),
        spans_of(F.col("text"), ACCESS, "access").alias("access"),
        spans_of(F.col("text"), HEX, "hex").alias("hex"),
        spans_of(F.col("text"), ACCOUNT, "account").alias("account"),
        spans_of(F.col("text"), ENDPOINT, "endpoint").alias("endpoint"),
        spans_of(F.col("text"), CANDIDATE, "candidate").alias("candidate"),
    )
    scanned = stage(scanned, "secret-parts")

    parts = scanned.select("row", F.explode(F.concat("assign", "access", "hex", "account", "endpoint", "candidate")).alias("p")).select("row", "p.*")
    weak = parts.where(F.col("kind").isin("account", "endpoint", "candidate"))
    weak = weak.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor((F.col("end") - 1) / scope) + 1)))
    strong = parts.select("row", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))).alias("bin"), F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    near = weak.join(strong, ["row", "bin"]).where((F.col("start2") < F.col("end") + scope) & (F.col("end2") > F.col("start") - scope))
    apart = (F.col("start2") >= F.col("end")) | (F.col("end2") <= F.col("start"))
    has = lambda *kinds: F.bool_or(apart & F.col("kind2").isin(*kinds))
    covered = F.bool_or(~apart & F.col("kind2").isin(*BASE_KINDS))
    confirmed = (
        near.groupBy("row", "kind", "start", "end")
        .agg(has("account").alias("account"), has("endpoint").alias("endpoint"), has("access").alias("access"), has("assign", "hex").alias("secret"), has("candidate").alias("candidate"), covered.alias("covered"))
        .where(~F.col("covered"))
        .where(
            F.when(F.col("kind") == "candidate", F.col("access") | (F.col("account") & F.col("endpoint")))
            .when(F.col("kind") == "account", F.col("secret") | (F.col("endpoint") & F.col("candidate")))
            .otherwise(F.col("secret") | F.col("access") | (F.col("account") & F.col("candidate")))
        )
    )
    kinds = [*BASE_KINDS, "account", "endpoint", "candidate"]
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    ordered = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    links = confirmed.groupBy("row").agg(F.collect_list(F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("weak"))
    out = scanned.select("row", "id", F.concat("assign", "access", "hex").alias("base")).join(links, "row", "left").withColumn("weak", F.coalesce("weak", F.array().cast(SPAN)))
    return out.select(F.col("id").alias(id_col), ordered(F.col("base")).alias("base"), ordered(F.col("weak")).alias("weak"), ordered(F.concat("base", "weak")).alias("spans"))


def _long_enough(assignment: Column) -> Column:
    """Its value has 12 or more characters. Shorter ones still take up their text."""
    value = r"""(?s)^.*?[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
    return F.length(F.regexp_extract(assignment, value, 1)) >= 12


#: Code points to a block in which spans are cut out: a place costs a block's length, not the text's.
CUT = 512


def _regions(spans: DataFrame) -> DataFrame:
    """(row, start, end, kind) of maximal runs of spans that overlap; the first names its run."""
    inside = Window.partitionBy("row").orderBy("start", "rank", "end")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    runs = begun.withColumn("run", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "rank", "end")).alias("kind"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """The same rows and columns; every run of spans that overlap is replaced by [kind], the kind of its first.

    Texts with findings are cut into blocks, a row each, and put together again, so work is linear in the text and its spans.
    """
    row, clean = free_name(docs, "row_of"), free_name(docs, "clean")
    marked = stage(docs.withColumn(row, F.monotonically_increasing_id()), "to-redact")
    text = F.col(f"`{text_col}`")
    found = find_secrets(marked.select(F.col(row).alias("id"), text.alias("text")), "id", "text", scope)
    spans = found.select(F.col("id").alias("row"), F.posexplode("spans").alias("rank", "s")).select("row", "rank", "s.*")
    regions = stage(_regions(spans), "regions")
    texts = marked.select(F.col(row).alias("row"), text.cast("string").alias("text")).join(regions.select("row").distinct(), "row", "left_semi")
    blocks = texts.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))).alias("block", "piece"))
    cuts = regions.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / CUT).cast("int"), F.floor((F.col("end") - 1) / CUT).cast("int"))))
    at = F.col("block") * CUT
    cuts = cuts.select(
        "row",
        "block",
        F.greatest(F.col("start") - at, F.lit(0)).alias("start"),
        F.least(F.col("end") - at, F.lit(CUT)).alias("end"),
        F.when(F.col("start") >= at, F.concat(F.lit("["), "kind", F.lit("]"))).otherwise(F.lit("")).alias("mark"),
    )
    cuts = cuts.groupBy("row", "block").agg(F.sort_array(F.collect_list(F.struct("start", "end", "mark"))).alias("cuts"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, c: F.struct(c["end"].cast("int").alias("at"), F.concat(a["out"], F.substring("piece", a["at"] + 1, c["start"].cast("int") - a["at"]), c["mark"]).alias("out"))
    rest = F.aggregate("cuts", begin, step, lambda a: F.concat(a["out"], F.substring("piece", a["at"] + 1, F.lit(CUT))))
    pieces = blocks.join(cuts, ["row", "block"], "left").select("row", "block", F.when(F.col("cuts").isNull(), F.col("piece")).otherwise(rest).alias("piece"))
    whole = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("p")).select(F.col("row").alias(row), F.array_join("p.piece", "").alias(clean))
    whole = stage(whole, "redacted")
    unstage(regions)
    return marked.join(whole, row, "left").withColumn(text_col, F.coalesce(clean, text)).select(*[f"`{c}`" for c in docs.columns])

