"""URL filters: host and path rules first, gradient-boosted trees on lexical features for what no rule decides.

Features are counts and ratios of the url's characters, and how often labelled urls with the same host suffix were
blocked. They fall into equal bins; trees are grown level by level from sums of gradients per node, feature and bin, which
Spark adds up over the distinct rows of bins. Gradients are rounded to whole numbers before they are added, so the trees
do not depend on the partitioning. Both classes weigh alike, however many labelled urls each has. Everything is built from
column functions.

Cases: a null url, and one without ``://``, has an empty host and path; only the model judges it, as an empty text if it is
null. Null labels are left out of training; with no labels, or labels of one class alone, the model's verdict is that
class (without any, allow). Rows may repeat, each is judged, and each counts in training. Columns other than id and url
are not read. An empty table gives an empty result. Urls are read whole, at any length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.storage import materialise

from .common import let

#: Labelled urls that trees are fitted on, about (by hash of the url: all copies of a url are in or out).
SAMPLE_URLS = 200_000
TREES, DEPTH, RATE, SMOOTH = 8, 3, 0.5, 1.0
#: Host suffixes share so many cells for their statistics, and each cell has a prior of so many urls.
CELLS, PRIOR = 4096, 20.0
BINS = 32
#: Gradients are held as whole multiples of this.
UNIT = 2.0 ** -20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Features and the width of their bins.
WIDTHS = {
    "length": 8.0, "host_length": 4.0, "path_length": 4.0, "host_depth": 1.0, "path_depth": 1.0, "digit_ratio": 1 / 32,
    "entropy": 0.2, "parameters": 1.0, "hyphens": 1.0, "top_rate": 1 / 32, "suffix_rate": 1 / 32,
}
FEATURES = list(WIDTHS)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of ``rules`` (verdict, host and path) that fits; of equal ones the first."""
    out = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule: string, verdict: string>")
    return F.coalesce(*out, none)


def entropy(text: Column) -> Column:
    """Bits a character, from the counts of its characters; the sum runs in order of the characters."""
    def bits(chars):
        n = F.size(chars).cast("double")
        run = F.aggregate(
            F.array_sort(chars),
            F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("sum")),
            lambda a, c: F.when(a["last"] == c, F.struct(c.alias("last"), (a["n"] + 1).alias("n"), a["sum"].alias("sum")))
            .otherwise(F.struct(c.alias("last"), F.lit(1).alias("n"),
                                (a["sum"] + _plogp(a["n"].cast("double"), n)).alias("sum"))),
            lambda a: a["sum"] + _plogp(a["n"].cast("double"), n),
        )
        return F.when(F.size(chars) == 0, F.lit(0.0)).otherwise(run)

    return let(F.filter(F.split(text, "", -1), lambda c: c != F.lit("")), bits)


def _plogp(k: Column, n: Column) -> Column:
    return F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(F.lit(0.0))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def suffix_cells(host: Column) -> dict[str, Column]:
    """Cells of the last label of a host and of its last two."""
    def cell(n):
        return F.pmod(F.xxhash64(F.lit(n), F.substring_index(host, ".", -n)), F.lit(CELLS)).cast("int")

    return {"top_cell": cell(1), "suffix_cell": cell(2)}


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with the columns ``__`` + feature (those of the text alone) and the two cells."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("__host"), F.col("__path")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    values = {
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "host_depth": _count(host, ".") + F.when(host == "", 0).otherwise(1),
        "path_depth": _count(path, "/"),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]+", "")) / n,
        "entropy": entropy(u),
        "parameters": F.when(F.instr(u, "?") > 0, 1 + _count(u, "&")).otherwise(0),
        "hyphens": _count(host, "-"),
    }
    parts = urls.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    return parts.withColumns({f"__{k}": v.cast("double") for k, v in values.items()}
                             | {f"__{k}": v for k, v in suffix_cells(host).items()})


@dataclass
class Model:
    """``start``: log odds before any tree; ``rates``: blocked share by (kind of cell, cell), with classes of equal weight;
    ``trees``: leaves as (steps, value), a step being (feature, bin, goes right)."""

    start: float = 0.0
    rates: list[tuple[str, int, float]] = field(default_factory=list)
    trees: list[list[tuple[tuple[tuple[int, int, bool], ...], float]]] = field(default_factory=list)


def binned(values: Column, feature: str) -> Column:
    return F.greatest(F.least(F.floor(values / F.lit(WIDTHS[feature])), F.lit(BINS - 1)), F.lit(0)).cast("int")


def with_bins(features: DataFrame, model: Model) -> DataFrame:
    """Columns ``b0``, ``b1``, ...: the bins. The tables of rates have at most 2 * CELLS rows, so they are broadcast."""
    spark = features.sparkSession
    out = features
    for name in ("top", "suffix"):
        rows = [(c, r) for kind, c, r in model.rates if kind == name]
        rates = spark.createDataFrame(rows, f"__{name}_cell int, __{name}_rate double")
        out = out.join(F.broadcast(rates), f"__{name}_cell", "left").fillna(0.5, [f"__{name}_rate"])
    return out.withColumns({f"b{i}": binned(F.col(f"__{name}"), name) for i, name in enumerate(FEATURES)})


def _reached(steps) -> Column:
    out = F.lit(True)
    for feature, cut, right in steps:
        out = out & ((F.col(f"b{feature}") > cut) if right else (F.col(f"b{feature}") <= cut))
    return out


def score(model: Model) -> Column:
    """Log odds that an url is to be blocked, from its bins."""
    out = F.lit(model.start)
    for leaves in model.trees:
        value = F.lit(leaves[-1][1])
        for steps, leaf in reversed(leaves[:-1]):
            value = F.when(_reached(steps), F.lit(leaf)).otherwise(value)
        out = out + value
    return out


def _gain(g: int, h: int) -> float:
    return (g * UNIT) ** 2 / (h * UNIT + SMOOTH)


def best_split(sums: dict[tuple[int, int], tuple[int, int]]) -> tuple[tuple[int, int], list[tuple[int, int]]] | None:
    """The (feature, bin) after which a node is cut and the (gradient, curvature) of both sides, from those by (feature,
    bin); None: no cut gains anything."""
    best, found = 1e-9, None
    for feature in range(len(FEATURES)):
        bins = [sums.get((feature, b), (0, 0)) for b in range(BINS)]
        total = [sum(x[k] for x in bins) for k in (0, 1)]
        g = h = 0
        for cut in range(BINS - 1):
            g, h = g + bins[cut][0], h + bins[cut][1]
            sides = [(g, h), (total[0] - g, total[1] - h)]
            if min(x[1] for x in sides) * UNIT < 1.0:
                continue
            gain = sum(_gain(*x) for x in sides) - _gain(*total)
            if gain > best:
                best, found = gain, ((feature, cut), sides)
    return found


def _grow(rows: DataFrame, model: Model) -> list[tuple[tuple[tuple[int, int, bool], ...], float]]:
    """One tree: at each level the sums of all its nodes in one job (at most 2^DEPTH * features * BINS rows come back)."""
    chance = 1 / (1 + F.exp(-score(model)))
    graded = rows.withColumn("__p", chance).select(
        *[f"b{i}" for i in range(len(FEATURES))],
        F.round((F.col("y") - F.col("n") * F.col("__p")) / UNIT).cast("bigint").alias("g"),
        F.round(F.col("n") * F.col("__p") * (1 - F.col("__p")) / UNIT).cast("bigint").alias("h"))
    open_nodes, leaves = [((), None)], []
    for _ in range(DEPTH):
        if not open_nodes:
            break
        node = F.coalesce(*[F.when(_reached(steps), F.lit(i)) for i, (steps, _) in enumerate(open_nodes)])
        cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("b")) for i in range(len(FEATURES))])
        sums = graded.withColumn("__node", node).where("__node IS NOT NULL").select("__node", "g", "h", F.explode(cells).alias("c"))
        found: list[dict] = [{} for _ in open_nodes]
        for r in sums.groupBy("__node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            found[r["__node"]][r["f"], r["b"]] = (r["g"], r["h"])
        following = []
        for (steps, whole), here in zip(open_nodes, found):
            split = best_split(here)
            if split is None:
                leaves.append((steps, whole))
            else:
                cut, sides = split
                following += [((*steps, (*cut, right)), sides[right]) for right in (False, True)]
        open_nodes = following
    return [(steps, RATE * whole[0] * UNIT / (whole[1] * UNIT + SMOOTH)) for steps, whole in leaves + open_nodes if whole]


def train(labelled: DataFrame, url: str = "url", label: str = "blocked") -> Model:
    """A model from urls with a boolean ``label``. Statistics of suffixes cover all of them; trees about SAMPLE_URLS."""
    known = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("int").alias("y"))
    cells = suffix_cells(host_of(F.col("url")))
    counted = known.select("y", F.explode(F.array(*[
        F.struct(F.lit(k.removesuffix("_cell")).alias("kind"), c.alias("cell")) for k, c in cells.items()])).alias("c"))
    rows = counted.groupBy("c.kind", "c.cell").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in rows if r["kind"] == "top")
    blocked = sum(r["y"] for r in rows if r["kind"] == "top")
    if not 0 < blocked < n:
        return Model(start=1.0 if blocked else -1.0)
    weights = (n / (2 * (n - blocked)), n / (2 * blocked))

    def rate(r):
        y, other = r["y"] * weights[1], (r["n"] - r["y"]) * weights[0]
        return (y + PRIOR / 2) / (y + other + PRIOR)

    model = Model(rates=sorted((r["kind"], r["cell"], rate(r)) for r in rows))
    sample = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 32)) < min(1 << 32, (SAMPLE_URLS << 32) // n + 1))
    names = [f"b{i}" for i in range(len(FEATURES))]
    distinct = with_bins(lexical(sample), model).groupBy(*names).agg(
        F.sum("y").alias("y"), (F.count("*") - F.sum("y")).alias("other"))
    weighed = distinct.withColumn("y", F.col("y") * weights[1]).withColumn("n", F.col("y") + F.col("other") * weights[0])
    stored = materialise(weighed.drop("other"), "url-bins")
    for _ in range(TREES):
        tree = _grow(stored, model)
        if not tree:
            break
        model.trees.append(tree)
    return model


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str]], id_col: str = "page_id", url: str = "url"
          ) -> DataFrame:
    """Per row: id, host, path, rule (null: none fits), verdict (the rule's, else the model's), score (log odds)."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"))
    scored = with_bins(lexical(slim), model).withColumns({
        "score": score(model), "fit": fitting_rule(F.col("__host"), F.col("__path"), rules)})
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), "fit.rule",
        F.coalesce("fit.verdict", own).alias("verdict"), "score")


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """(url, blocked): the urls that a rule decides, as labelled by that rule; the others have a null label."""
    fit = fitting_rule(host_of(F.col(url)), path_of(F.col(url)), rules)
    return pages.select(F.col(url).alias("url"), (fit["verdict"] == "block").alias("blocked"))
