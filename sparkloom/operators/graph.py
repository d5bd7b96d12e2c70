"""The dependency graph as an edge table (src, dst, kind, ord): building, asking, editing and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..tables import cut


class CycleError(ValueError):
    """The edge would close a cycle."""

    def __init__(self, src: str, dst: str):
        super().__init__(f"an edge from {src!r} to {dst!r} would close a cycle")
        self.src, self.dst = src, dst


def stems(files: DataFrame) -> DataFrame:
    """(stem, file): the last file of each stem, by ord if there is one, else by name."""
    order = "ord" if "ord" in files.columns else "file"
    return files.groupBy(text.stem(F.col("file")).alias("stem")).agg(F.max_by("file", order).alias("file"))


def resolved(files: DataFrame) -> DataFrame:
    """(src, pos, dep, target): every dependency of files (file, dependencies[, ord]) with the file that it stands for, or null."""
    index = stems(files)
    name = index.select(F.col("file").alias("dep"), F.col("file").alias("by_name"))
    stem = lambda key, to: index.select(F.col("stem").alias(key), F.col("file").alias(to))
    deps = files.select(F.col("file").alias("src"), F.posexplode("dependencies").alias("pos", "dep")).withColumn("tail", F.element_at(F.split("dep", r"\."), -1))
    found = deps.join(name, "dep", "left").join(stem("dep", "by_stem"), "dep", "left").join(stem("tail", "by_tail"), "tail", "left")
    return found.select("src", "pos", "dep", F.coalesce("by_name", "by_stem", "by_tail").alias("target"))


def build(files: DataFrame) -> DataFrame:
    """Edges from files (file, dependencies[, ord]).

    A dependency is the file of that name (if its stem is that file's), else of that stem, else of the stem after its last
    dot.  What is found elsewhere is internal; the rest, and a file's own name, is external as written.  Repeats keep
    their first place.
    """
    found = resolved(files)
    internal = F.col("target").isNotNull() & (F.col("target") != F.col("src"))
    edges = found.select("src", F.when(internal, F.col("target")).otherwise(F.col("dep")).alias("dst"), F.when(internal, "internal").otherwise("external").alias("kind"), "pos")
    return edges.groupBy("src", "dst", "kind").agg(F.min("pos").alias("ord"))


def adjacency(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, internal, external) with lists in order; every file of files, if given."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "dst")))), lambda x: x["dst"]).alias(kind)
    lists = edges.groupBy(F.col("src").alias("file")).agg(of("internal"), of("external"))
    if files is None:
        return lists
    empty = F.array().cast("array<string>")
    return files.select("file").join(lists, "file", "left").select("file", F.coalesce("internal", empty).alias("internal"), F.coalesce("external", empty).alias("external"))


def internal(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'internal'") if "kind" in edges.columns else edges


def dependents(edges: DataFrame, file: str) -> DataFrame:
    """(file): who depends on it directly."""
    return internal(edges).where(F.col("dst") == file).select(F.col("src").alias("file")).distinct()


def closure(edges: DataFrame, seeds: DataFrame, *, every: int = 4) -> DataFrame:
    """(seed, node): what each seed reaches along (src, dst) in one step or more; itself only through a cycle.

    Rounds extend the newest nodes by one step.  Edges and nodes stay in tables; a round ends in one, so the plan stays
    short and survives lost executors.
    """
    step = cut(edges.select("src", "dst").distinct(), "edges")
    newest = seeds.select("seed", F.col("seed").alias("src")).join(step, "src").select("seed", F.col("dst").alias("node")).distinct()
    newest = cut(newest, "reached")
    seen = newest
    rounds = 0
    while not newest.isEmpty():
        ahead = newest.withColumnRenamed("node", "src").join(step, "src").select("seed", F.col("dst").alias("node")).distinct()
        newest = cut(ahead.join(seen, ["seed", "node"], "left_anti"), "reached")
        seen = seen.union(newest)
        rounds += 1
        if rounds % every == 0:
            seen = cut(seen, "reached")
    return seen


def blast_radius(edges: DataFrame, file: str) -> DataFrame:
    """(file): everything that depends on it, over any number of steps."""
    return blast_radii(edges, edges.sparkSession.createDataFrame([(file,)], "seed string")).select(F.col("node").alias("file"))


def blast_radii(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) for many seeds at once."""
    return closure(internal(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)


def reaches(edges: DataFrame, start: str, goal: str, *, every: int = 4) -> bool:
    """Whether goal can be reached from start; every file reaches itself.

    The search goes from both ends, always on from the side with fewer new files, until the sides meet or one has no more.
    """
    if start == goal:
        return True
    step = cut(internal(edges).select("src", "dst"), "edges")
    newest = [edges.sparkSession.createDataFrame([(x,)], "node string") for x in (start, goal)]
    seen, sizes, rounds = list(newest), [1, 1], 0
    while True:
        side = int(sizes[1] < sizes[0])
        here, there = ("src", "dst")[:: 1 - 2 * side]
        ahead = step.join(newest[side].withColumnRenamed("node", here), here).select(F.col(there).alias("node")).distinct()
        ahead = cut(ahead.join(seen[side], "node", "left_anti"), "reached")
        sizes[side] = ahead.count()
        if not sizes[side]:
            return False
        if not ahead.join(seen[1 - side], "node", "left_semi").isEmpty():
            return True
        newest[side], seen[side], rounds = ahead, seen[side].union(ahead), rounds + 1
        if rounds % every == 0:
            seen = [cut(x, "reached") for x in seen]


# ---- edits: each gives a new edge table


def _known(files: DataFrame, *names: str) -> None:
    have = {r["file"] for r in files.where(F.col("file").isin(list(names))).select("file").collect()}
    for name in names:
        if name not in have:
            raise ValueError(f"unknown file: {name}")


def link(edges: DataFrame, files: DataFrame, src: str, dst: str) -> DataFrame:
    """With the edge src -> dst, at the end of src's list; an edge that is there stays as it is."""
    _known(files, src, dst)
    if src == dst:
        raise ValueError("a file can't depend on itself")
    if reaches(edges, dst, src):
        raise CycleError(src, dst)
    last = edges.where((F.col("src") == src) & (F.col("kind") == "internal")).agg(F.coalesce(F.max("ord") + 1, F.lit(0)).cast("int").alias("ord"))
    new = last.select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), F.lit("internal").alias("kind"), "ord")
    return edges.unionByName(new.join(edges.where("kind = 'internal'").select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns))


def unlink(edges: DataFrame, files: DataFrame, src: str, dst: str) -> DataFrame:
    """Without the internal edge src -> dst, if there is one."""
    _known(files, src)
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst) & (F.col("kind") == "internal")))


def move(edges: DataFrame, files: DataFrame, file: str, parent: str) -> DataFrame:
    """With file below parent and nowhere else; the cycle test looks at the graph as it was."""
    _known(files, file, parent)
    if file == parent:
        raise ValueError("a file can't be its own parent")
    if reaches(edges, file, parent):
        raise CycleError(parent, file)
    rest = edges.where(~((F.col("dst") == file) & (F.col("kind") == "internal")))
    last = rest.where((F.col("src") == parent) & (F.col("kind") == "internal")).agg(F.coalesce(F.max("ord") + 1, F.lit(0)).cast("int").alias("ord"))
    return rest.unionByName(last.select(F.lit(parent).alias("src"), F.lit(file).alias("dst"), F.lit("internal").alias("kind"), "ord").select(*edges.columns))


# ---- the same edits of dependencies as written, before edges are built: each gives new files (file, dependencies, ...)


def _without(files: DataFrame, target: str, src: str | None = None) -> DataFrame:
    """Without the dependencies that stand for target, of one file or of all."""
    gone = (F.col("target") == target) & (F.lit(True) if src is None else F.col("src") == src)
    rest = resolved(files).where(~F.coalesce(gone, F.lit(False))).groupBy(F.col("src").alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dep"))), lambda x: x["dep"]).alias("_rest"))
    kept = F.coalesce("_rest", F.array().cast("array<string>")).alias("dependencies")
    return files.join(rest, "file", "left").select(*(kept if c == "dependencies" else c for c in files.columns))


def _appended(files: DataFrame, src: str, dst: str) -> DataFrame:
    own = F.coalesce("dependencies", F.array().cast("array<string>"))
    return files.withColumn("dependencies", F.when(F.col("file") == src, F.array_append(own, F.lit(dst))).otherwise(F.col("dependencies")))


def link_written(files: DataFrame, src: str, dst: str) -> DataFrame:
    """With dst among src's dependencies, at the end, unless one of them stands for it already."""
    _known(files, src, dst)
    if src == dst:
        raise ValueError("a file can't depend on itself")
    if reaches(build(files), dst, src):
        raise CycleError(src, dst)
    there = resolved(files).where((F.col("src") == src) & (F.col("target") == dst))
    return _appended(files, src, dst) if there.isEmpty() else files


def unlink_written(files: DataFrame, src: str, dst: str) -> DataFrame:
    """Without src's dependencies that stand for dst."""
    _known(files, src)
    return _without(files, dst, src)


def move_written(files: DataFrame, file: str, parent: str) -> DataFrame:
    """With file among the dependencies of parent, at the end, and of no other file."""
    _known(files, file, parent)
    if file == parent:
        raise ValueError("a file can't be its own parent")
    if reaches(build(files), file, parent):
        raise CycleError(parent, file)
    return _appended(_without(files, file), parent, file)


# ---- views


def roots(files: DataFrame, edges: DataFrame, *, fallback: bool = True) -> DataFrame:
    """(file): those that nothing depends on; all of them if there are none and fallback is set."""
    own = files.select("file").join(internal(edges).select(F.col("dst").alias("file")).distinct(), "file", "left_anti")
    return files.select("file") if fallback and own.isEmpty() else own


def reverse_index(edges: DataFrame) -> DataFrame:
    """(file, dependents) with sorted lists."""
    return internal(edges).groupBy(F.col("dst").alias("file")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))


def ego(edges: DataFrame, file: str, most: int = 6) -> DataFrame:
    """(side, file, place, more): up to ``most`` parents and children of a file, and how many more there are."""
    own = internal(edges)
    parents = own.where(F.col("dst") == file).select(F.lit("parent").alias("side"), F.col("src").alias("file"), F.lit(0).alias("o"))
    children = own.where(F.col("src") == file).select(F.lit("child").alias("side"), F.col("dst").alias("file"), F.col("ord").alias("o"))
    ranked = parents.unionByName(children).withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy("o", "file"))).withColumn("n", F.count("*").over(Window.partitionBy("side")))
    return ranked.where(F.col("place") <= most).select("side", "file", "place", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def short_labels(files: DataFrame) -> DataFrame:
    """(file, label): the base name, with its folder where another file has the same one."""
    base = text.basename(F.col("file"))
    shared = files.groupBy(base.alias("base")).agg((F.count("*") > 1).alias("shared"))
    parts = F.split("file", "/")
    with_folder = F.when(F.size(parts) > 1, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("file"))
    return files.select("file", base.alias("base")).join(shared, "base").select("file", F.when(F.col("shared"), with_folder).otherwise(F.col("base")).alias("label"))


def flagged(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Internal edges with the target's confidence, 1.0 where there is none."""
    scored = files.select(F.col("file").alias("dst"), "confidence")
    return internal(edges).join(scored, "dst", "left").select("src", "dst", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def overview(edges: DataFrame, files: DataFrame, low: float = 0.34) -> DataFrame:
    """(src, dst, confidence, low, top): the edges of a whole tree, whether the target needs a look and the source is a root."""
    tops = roots(files, edges).select(F.col("file").alias("src"), F.lit(True).alias("top"))
    return flagged(edges, files).join(tops, "src", "left").select("src", "dst", "confidence", (F.col("confidence") < low).alias("low"), F.coalesce("top", F.lit(False)).alias("top"))


def link_candidates(files: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """(file): what could still be linked from a file."""
    taken = internal(edges).where(F.col("src") == file).select(F.col("dst").alias("file"))
    return files.select("file").where(F.col("file") != file).join(taken, "file", "left_anti")


def tree_lines(files: list[str], adjacency: dict[str, dict[str, list[str]]], *, fallback: bool = True) -> list[str]:
    """The tree of one project as indented lines, for a terminal: a file isn't shown again below itself."""
    below = {c for a in adjacency.values() for c in a["internal"]}
    tops = [f for f in files if f not in below] or (list(files) if fallback else [])
    out: list[str] = []

    def show(name: str, depth: int, above: frozenset[str]) -> None:
        out.append("    " * depth + name)
        if name in above:
            return
        own = adjacency.get(name, {"internal": [], "external": []})
        for child in own["internal"]:
            if child not in above | {name}:
                show(child, depth + 1, above | {name})
        out.extend("    " * (depth + 1) + f"[{e}]" for e in own["external"])

    for top in tops:
        show(top, 0, frozenset())
    return out
