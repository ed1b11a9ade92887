"""URL filters: rules first, then trust and distrust propagated over the host graph.

Hosts are linked by the absolute links of their pages, and each host with its parent domain, both ways, unless the parent is a
suffix under which anybody registers names: of ``suffixes``, or of one label. Personalised
PageRank from trusted seeds follows the edges; distrust follows them backwards from blocked seeds: who links to a
blocked host is suspect. Seeds are the hosts of pages that an allowing or blocking rule fits, by number of pages. A page
without a rule gets its host's verdict: block if distrust is above ``threshold`` times trust by more than the share EVEN.

Ranks are the fixed point in which mass at hosts without edges onward returns to the seeds. It is proportional to the sum
over all walks from the seeds, to which a step adds the walks that are one longer; the sums are scaled to 1 at the end. After every few
steps the iterates are combined with the weights, adding to 1, whose combined last moves are least (reduced rank extrapolation);
the weights come from the moves' inner products, a few numbers for the whole table. Steps shrink what is missing to ``damping`` of
it at least, so the last step's size bounds the error: rounds end when it is below ``tolerance`` of the whole, however the weights were.
Both sides walk together, with the same weights.

Each step is a join of ranks with edges and a grouped sum, map-side combined. Edges are kept in buckets by their start,
so that rounds shuffle ranks only; a host of many edges has them in several buckets, and its rank goes to each.

Defined cases: a null url or one without "://" has an empty host and path, no rule, and is allowed; a null page has no
links; repeated rows get repeated results; an empty table gives an empty one; no other column is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.native import A_TO_Z
from sievegrid.session import bucketed, stage, unstage

#: Ranks that differ by no more than this share are even: the order of their sums may tell them apart.
EVEN = 1e-6
#: Edges of one host to a bucket, about.
EDGES_PER_SALT = 100_000
#: Steps from one combination to the next.
STRIDE = 8
# Suffixes of two labels under which names are registered. Callers with the whole public list pass theirs.
SUFFIXES = (
    "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.ph", "com.pk", "com.pl", "com.sg",
    "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "govt.nz", "me.uk",
    "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "net.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.nz",
    "org.uk", "org.za", "sch.uk",
)
#: (verdict, host, path).
Rule = tuple[str, str, str]
#: A link's target from its scheme or, where it takes the page's, from its slashes.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, A_TO_Z, A_TO_Z.lower())


def path_of(url: Column) -> Column:
    return F.substring_index(F.substring_index(F.regexp_replace(_after_scheme(url), r"(?s)^[^/?#]*", ""), "?", 1), "#", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of rules of one length the first in order of text."""
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.lit(rule_host + rule_path)).otherwise(chosen)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return chosen, verdict


def host_edges(pages: DataFrame, host: str, html: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(src, dst, weight) from links between hosts and between a host and its parent domain."""
    links = pages.where(F.col(html).contains("//")).select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("link"))
    linked = links.select("src", host_of(F.concat(F.lit(":"), "link")).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    own = pages.select(F.col(host).alias("src")).distinct()
    parent = F.regexp_replace("src", r"^[^.]*\.", "")
    up = own.where(F.size(F.split("src", r"\.")) > 2).select("src", parent.alias("dst"), F.lit(1.0).alias("weight")).where(~F.col("dst").isin(*suffixes))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = linked.unionByName(up).unionByName(down)
    return both.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, most_rounds: int = 2000) -> DataFrame:
    """(side, host, rank): personalised PageRank on each side, its ranks summing to 1, in all within about ``tolerance`` of them.

    edges: (side, src, dst, weight); seeds: (side, host, mass), masses above 0.
    """
    out = stage(edges.groupBy("side", "src").agg(F.sum("weight").alias("out"), F.ceil(F.count(F.lit(1)) / F.lit(EDGES_PER_SALT)).cast("int").alias("fans")), "out-weights")
    ahead = out.select("side", F.col("src").alias("dst"), F.col("fans").alias("fans_on"))
    steps = edges.join(out, ["side", "src"]).join(ahead, ["side", "dst"], "left")
    steps = steps.select("side", "src", F.pmod(F.xxhash64("dst"), "fans").cast("int").alias("salt"), "dst", (F.col("weight") / F.col("out")).alias("share"), F.coalesce("fans_on", F.lit(0)).alias("next_fans"))
    total = seeds.groupBy("side").agg(F.sum("mass").alias("total"))
    start = seeds.join(total, "side").join(out.select("side", F.col("src").alias("host"), "fans"), ["side", "host"], "left")
    start = stage(start.select("side", "host", (F.col("mass") / F.col("total") * (1 - damping)).alias("rank"), F.coalesce("fans", F.lit(0)).alias("fans"), F.lit(None).cast("array<double>").alias("past")), "seeds")
    ranks, before = start.withColumn("past", F.array("rank")), None
    last = F.element_at("past", -1)
    with bucketed(steps, "host-steps", ["side", "src", "salt"], edges.count()) as kept:
        for _ in range(0, most_rounds, STRIDE):
            for k in range(1, STRIDE + 1):
                spread = ranks.select("side", F.col("host").alias("src"), last.alias("rank"), "fans", "past", F.explode(F.sequence(F.lit(-1), F.col("fans") - 1)).alias("salt"))
                spread = spread.withColumn("past", F.when(F.col("salt") < 0, F.col("past")))  # salt -1 keeps a host's own row, the plan reads ranks once
                moved = spread.join(kept, ["side", "src", "salt"], "left").where("salt < 0 or dst is not null")
                own = F.col("salt") < 0
                moved = moved.select(
                    "side",
                    F.when(own, F.col("src")).otherwise(F.col("dst")).alias("host"),
                    F.when(own, F.lit(0.0)).otherwise(F.col("rank") * F.col("share") * damping).alias("rank"),
                    F.when(own, F.col("fans")).otherwise(F.col("next_fans")).alias("fans"),
                    "past",
                )
                every = moved.unionByName(start)
                past = F.coalesce(F.max("past"), F.array_repeat(F.lit(0.0), k))
                ranks = every.groupBy("side", "host").agg(F.max("fans").alias("fans"), F.concat(past, F.array(F.sum("rank"))).alias("past"))
            ranks = stage(ranks, "ranks")
            if before is not None:
                unstage(before)
            moves = _moves(ranks)
            if all(m["last"] * damping <= tolerance * (1 - damping) * m["total"] for m in moves):
                scaled = ranks.join(ranks.groupBy("side").agg(F.sum(last).alias("total")), "side")
                return scaled.select("side", "host", F.greatest(last / F.col("total"), F.lit(0.0)).alias("rank"))
            weights = _least_move(sum(np.array(m["products"]) for m in moves))
            before, ranks = ranks, ranks.withColumn("past", F.array(sum(F.col("past")[j + 1] * float(w) for j, w in enumerate(weights))))
    raise RuntimeError(f"ranks did not settle in {most_rounds} rounds")


def _moves(ranks: DataFrame) -> list:
    """A row a side: its ranks' sum, the last step's size and the inner products of all steps."""
    step = [F.col("past")[j + 1] - F.col("past")[j] for j in range(STRIDE)]
    products = F.array(*[F.sum(a * b) for a in step for b in step])
    return ranks.groupBy("side").agg(F.sum(F.element_at("past", -1)).alias("total"), F.sum(F.abs(step[-1])).alias("last"), products.alias("products")).collect()


def _least_move(products: np.ndarray) -> np.ndarray:
    """The weights, adding to 1, of least combined move; the last step alone where rounding leaves none."""
    gram = products.reshape(STRIDE, STRIDE)
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    found = np.linalg.solve(gram / np.outer(size, size) + 1e-13 * np.eye(STRIDE), 1 / size) / size
    alone = np.eye(STRIDE)[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = found / found.sum()
    return weights if np.isfinite(weights).all() and np.abs(weights).sum() < 1e6 else alone


def url_filter(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    tolerance: float = 1e-10,
    threshold: float = 1.0,
    suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust), a row a page."""
    url = F.col(f"`{url_col}`").cast("string")
    read = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    judged = read.select("id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    linked = stage(host_edges(read, "host", "html", suffixes), "host-edges")
    votes = stage(judged.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("trust"), F.count_if(F.col("ruled") == "block").cast("double").alias("distrust")), "votes")
    edges = linked.select(F.lit("trust").alias("side"), "src", "dst", "weight").unionByName(linked.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    seeds = votes.select("host", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("mass")) for s in ("trust", "distrust")])).alias("v")).select("v.side", "host", "v.mass").where("mass > 0")
    ranks = propagate(edges, seeds, damping, tolerance).groupBy("host").agg(*[F.sum(F.when(F.col("side") == s, F.col("rank")).otherwise(0.0)).alias(s) for s in ("trust", "distrust")])
    scored = stage(votes.select("host").join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"]), "host-scores").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    method = F.when(F.col("distrust") > F.col("trust") * threshold * (1 + EVEN), F.lit("block")).otherwise(F.lit("allow"))
    joined = judged.withColumn("salt", F.pmod(F.hash("id", "path"), F.lit(32))).join(scored, ["host", "salt"], "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("host") == "", F.lit("allow")), method, F.lit("allow")).alias("verdict"), "trust", "distrust")
