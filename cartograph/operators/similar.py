"""Files alike (mirror) and files worth splitting."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.functions.glob import jaccard
from cartograph.operators.metrics import fans


def signatures(files: DataFrame, imports: DataFrame, symbols: DataFrame, file_edges: DataFrame) -> DataFrame:
    """path, language, import_set, kind_set, exports, fan_in, fan_out: one aggregation for all files."""
    target = F.coalesce("resolved_path", "external_pkg", "raw_text")
    i = imports.groupBy("path").agg(F.collect_set(target).alias("import_set"))
    kinds = F.collect_set(F.translate("kind", "_", ""))
    s = symbols.where("exported").groupBy("path").agg(kinds.alias("kind_set"), F.count("*").alias("exports"))
    empty = F.array().cast("array<string>")
    return (
        files.select("path", "language").join(i, "path", "left").join(s, "path", "left").join(fans(file_edges, files), "path")
        .select("path", "language", F.coalesce("import_set", empty).alias("import_set"), F.coalesce("kind_set", empty).alias("kind_set"), F.coalesce("exports", F.lit(0)).alias("exports"), "fan_in", "fan_out")
    )


def mirror(files: DataFrame, imports: DataFrame, symbols: DataFrame, file_edges: DataFrame, path: str, other: str | None = None, threshold: float = 0.0, top: int | None = None) -> DataFrame:
    """path, score, normalized_score: files of the same language by likeness to one file."""
    own = files.where(F.col("path") == path).select(F.col("language").alias("language"))
    near = files.where(F.col("path").isin(path, other)) if other else files.join(F.broadcast(own), "language", "left_semi")  # one row
    keep = near.select("path")
    sig = signatures(near, imports.join(keep, "path", "left_semi"), symbols.join(keep, "path", "left_semi"), file_edges)
    own = sig.where(F.col("path") == path).select(*[F.col(c).alias(f"t_{c}") for c in sig.columns])
    c = sig.where(F.col("path") != path).crossJoin(F.broadcast(own))  # one row
    c = c.where(F.col("path") == other) if other else c.where(F.col("language") == F.col("t_language"))
    gap = F.abs(F.col("fan_in") - F.col("t_fan_in")) + F.abs(F.col("fan_out") - F.col("t_fan_out"))
    score = (
        0.45 * jaccard(F.col("import_set"), F.col("t_import_set")) + 0.25 * jaccard(F.col("kind_set"), F.col("t_kind_set"))
        + 0.15 * (1 - F.least(gap, F.lit(10)) / 10) + 0.15 * (1 - F.least(F.abs(F.col("exports") - F.col("t_exports")), F.lit(6)) / 6)
    )
    out = c.select("path", score.alias("score")).where(F.col("score") >= threshold).withColumn("normalized_score", F.round(100 * F.col("score")).cast("long"))
    return out if top is None else out.orderBy(F.desc("normalized_score"), "path").limit(top)


def caller_profiles(symbols: DataFrame, symbol_edges: DataFrame, path: str) -> DataFrame:
    """qualname, kind, line, callers: the files that call each symbol of a file."""
    calls = symbol_edges.where(F.col("dst_path") == path).groupBy(F.col("dst").alias("qualname")).agg(F.array_sort(F.collect_set("src_path")).alias("callers"))
    own = symbols.where(F.col("path") == path).select("qualname", "kind", F.col("start_line").alias("line"))
    return own.join(calls, "qualname", "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))


# The plural that names a cluster by its commonest kind, the wording of rationales and warnings, and the default number of clusters.
PLURAL = {
    "function": "functions", "method": "methods", "struct": "structs", "class": "classes", "enum": "enums", "type_alias": "type_aliases", "module": "modules", "namespace": "namespaces",
    "constant": "constants", "static": "statics", "interface": "interfaces", "trait": "traits", "variable": "variables",
}
ALONE = "symbols share little external call evidence and are grouped by local structure"
SHARED = "symbols share inbound usage from {} indexed file(s), led by {}"
TOO_SMALL = "exported symbol set was too small for clustering; used all indexed symbols"
NO_SYMBOLS = "target has no indexed symbols to cluster"
NO_SIGNAL = "target topology does not show a strong split signal yet"
CLUSTERS = 3


def split_rows(symbols: DataFrame) -> DataFrame:
    """path, qualname, name, kind, exported, line, widened: the symbols of each file that are clustered, widened where it exports fewer than two.

    A file with fewer than two exported symbols takes all of its own; modules are always left out.
    """
    of_file = Window.partitionBy("path")
    rows = symbols.where("path IS NOT NULL").withColumns({"few": F.count_if("exported").over(of_file) < 2, "n": F.count("*").over(of_file)}).where(F.col("few") | F.col("exported")).where("kind <> 'module'")
    return rows.select("path", "qualname", "name", "kind", "exported", F.col("start_line").alias("line"), (F.col("few") & (F.col("n") >= 2)).alias("widened"))


def usage(rows: DataFrame, symbol_edges: DataFrame) -> DataFrame:
    """path, used (sorted qualnames), files, first, second: how many calling files use exactly these symbols of a file, and the least two of them.

    Callers that use the same symbols are alike for every comparison of symbol sets, so a file's group holds one row for each such set, however many callers a
    symbol has. Calls and symbols move once, to the task of their file, which reads them sorted and in turn.
    """
    calls = symbol_edges.where("dst_path IS NOT NULL").select(F.col("dst_path").alias("path"), F.col("dst").alias("qualname"), "src_path", F.lit(False).alias("own")).repartition("path")
    own = rows.where("qualname IS NOT NULL").select("path", "qualname", F.lit(None).cast("string").alias("src_path"), F.lit(True).alias("own"))
    known = F.max("own").over(Window.partitionBy("path", "qualname"))
    called = own.unionByName(calls).withColumn("known", known).where("known AND NOT own")
    sets = called.groupBy("path", "src_path").agg(F.array_sort(F.collect_set("qualname")).alias("used"))
    place = F.row_number().over(Window.partitionBy("path", "used").orderBy(F.asc_nulls_last("src_path")))
    return sets.withColumn("place", place).groupBy("path", "used").agg(F.count("*").alias("files"), F.min("src_path").alias("first"), F.min(F.when(F.col("place") == 2, F.col("src_path"))).alias("second"))


def merge_order(sets: list[int], counts: list[int], wanted: int) -> list[list[int]]:
    """Agglomeration of items by the Jaccard likeness of their groups' united sets; sets are bit masks over kinds of callers, which count as given.

    The most alike pair is merged first, ties by place of the left, then of the right group, until ``wanted`` are left. Only pairs that have a caller in common are compared; two groups
    without any caller are alike, and groups with nothing in common merge last, in order.
    """
    weight = lambda mask: sum(c for i, c in enumerate(counts) if mask >> i & 1)
    groups = {i: [i] for i in range(len(sets))}
    union = dict(enumerate(sets))
    version = dict.fromkeys(groups, 0)
    heap: list[tuple] = []

    def offer(a: int, b: int) -> None:
        a, b = min(a, b), max(a, b)
        x, y = union[a], union[b]
        score = 1.0 if not (x or y) else weight(x & y) / weight(x | y)
        if score > 0:
            heapq.heappush(heap, (-score, a, b, version[a], version[b]))

    for a, b in combinations(groups, 2):
        if union[a] & union[b] or not (union[a] or union[b]):
            offer(a, b)
    while len(groups) > max(wanted, 1):
        while heap and not (version.get(heap[0][1]) == heap[0][3] and version.get(heap[0][2]) == heap[0][4]):
            heapq.heappop(heap)
        a, b = heapq.heappop(heap)[1:3] if heap else sorted(groups)[:2]
        groups[a] += groups.pop(b)
        union[a] |= union.pop(b)
        del version[b]
        version[a] += 1
        for other in groups:
            if other != a and (union[other] & union[a] or not (union[other] or union[a])):
                offer(a, other)
    return [groups[i] for i in sorted(groups)]


CLUSTER = "path string, id int, member int, qualname string, name string, kind string, exported boolean, line int, inbound_files long, cohesion_score double, suggested_name string, rationale string, warnings string"
NAMES = CLUSTER.replace(",", "").split(" ")[::2]
TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t] for t in CLUSTER.replace(",", "").split(" ")[1::2]]


def cluster_file(path: str, rows: list[dict], used: list[dict], clusters: int | None) -> Iterator[tuple]:
    """One file's clusters, a row a member, in the order of CLUSTER; rows come in order."""
    counts = [u["files"] for u in used]
    place: dict[str, int] = {}
    for i, u in enumerate(used):
        for q in u["used"]:
            place[q] = place.get(q, 0) | 1 << i
    sets = [place.get(r["qualname"], 0) for r in rows]
    weight = lambda mask: sum(c for i, c in enumerate(counts) if mask >> i & 1)
    wanted = max(min(clusters or min(len(rows), CLUSTERS), len(rows)), 1)
    found = sorted(sorted(g) for g in merge_order(sets, counts, wanted))
    warnings = "; ".join([TOO_SMALL] * rows[0]["widened"] + [NO_SIGNAL] * (len(found) <= 1))
    for n, members in enumerate(found, 1):
        alike = [1.0 if not (sets[a] | sets[b]) else weight(sets[a] & sets[b]) / weight(sets[a] | sets[b]) for a, b in combinations(members, 2)]
        kinds = [PLURAL[rows[i]["kind"]] for i in members]
        label = max(set(kinds), key=lambda k: (kinds.count(k), k))
        mask = 0
        for i in members:
            mask |= sets[i]
        callers = sorted(x for i, u in enumerate(used) if mask >> i & 1 for x in (u["first"], u["second"]) if x is not None)[:2]
        why = SHARED.format(len(callers), ", ".join(callers)) if callers else ALONE
        score = sum(alike) / len(alike) if alike else 1.0
        for m, i in enumerate(members, 1):
            r = rows[i]
            yield path, n, m, r["qualname"], r["name"], r["kind"], r["exported"], r["line"], weight(sets[i]), score, f"cluster_{n}_{label}", why, warnings


def split(symbols: DataFrame, symbol_edges: DataFrame, path: str | None = None, clusters: int | None = None) -> DataFrame:
    """CLUSTER: the symbols of each file (or of one) in clusters that share callers, a row a member.

    All files run at once. A file's row holds its symbols and the distinct sets of them that callers use.
    """
    if clusters is not None and clusters < 1:
        raise ValueError("split cluster count must be greater than 0")
    if path is not None:
        symbols, symbol_edges = symbols.where(F.col("path") == path), symbol_edges.where(F.col("dst_path") == path)
    rows = split_rows(symbols)
    each = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "qualname", "name", "kind", "exported", "widened"))).alias("rows"))
    sets = usage(rows, symbol_edges).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("used", "files", "first", "second"))).alias("used"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for p, x, u in zip(*(b.column(c).to_pylist() for c in ("path", "rows", "used")), strict=True) for r in cluster_file(p, x, u or [], clusters)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(TYPES)], NAMES)

    return each.join(sets, "path", "left").mapInArrow(run, CLUSTER)


def split_summary(rows: DataFrame) -> DataFrame:
    """path, target_symbols, exported_symbols, clusters, isolated_symbols of the rows of split()."""
    size = rows.groupBy("path", "id").agg(F.count("*").alias("n"), F.count_if("exported").alias("e"))
    return size.groupBy("path").agg(F.sum("n").alias("target_symbols"), F.sum("e").alias("exported_symbols"), F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("isolated_symbols"))
