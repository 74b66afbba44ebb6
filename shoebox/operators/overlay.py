"""Curated overlays on clusters: merges, moves, removals, names; and the cluster views.

``kind``-specific tables are passed in: ``merges(src, dst)``, ``moves(path, src, dst, seq)``,
``removed(id, path)``, ``names(id, name)``, ``skipped(id)``.  Cluster membership is
``members(id, path, seq)``, one row per detection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from . import graph, ranks
from .labels import last_row_wins


def merge_closure(merges: DataFrame) -> DataFrame:
    """``(src, dst)``: where following merges from ``src`` ends.

    A chain ends at its first node without a merge.  A chain into a cycle ends at the first node met
    twice, so a node on a cycle ends at itself.  Every round doubles the steps that each node has
    gone, so a chain of any length takes as many rounds as its length has binary digits.  What has
    not ended after as many steps as there are nodes stands on a cycle; those nodes then count as
    ends.  Of several merges of one node the greatest target counts; nulls are ignored.
    """
    steps = graph.materialize(merges.where("src is not null and dst is not null").groupBy("src").agg(F.max("dst").alias("dst")))
    ends, rest = _follow(steps, steps.count())
    if rest is None:
        return ends
    cycle = graph.materialize(rest.select(F.col("dst").alias("src")).distinct())
    entered, _ = _follow(graph.materialize(steps.join(cycle, "src", "left_anti")), None)
    return entered.unionByName(cycle.select("src", F.col("src").alias("dst")))


#: Doublings of one round; only their outcome is written.
_DOUBLINGS = 4


def _follow(steps: DataFrame, nodes: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(every node with its end, nodes that are on or before a cycle or None), by doubling steps."""
    state, gone = steps, 1
    while True:
        for _ in range(_DOUBLINGS):
            further = state.select(F.col("src").alias("dst"), F.col("dst").alias("_far"))
            state = state.select("src", "dst").join(further, "dst", "left").select("src", F.coalesce("_far", "dst").alias("dst"), F.col("_far").isNotNull().alias("moved"))
        state, gone = graph.materialize(state), gone << _DOUBLINGS
        open_ = state.where("moved")
        if open_.isEmpty():
            return state.select("src", "dst"), None
        if nodes is not None and gone > nodes:
            return state.select("src", "dst"), open_.select("src", "dst")


def resolve(rows: DataFrame, column: str, closure: DataFrame) -> DataFrame:
    """Replace ids in ``column`` by the end of their merge chain."""
    ends = closure.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    return rows.join(ends, rows[column] == ends["_src"], "left").withColumn(column, F.coalesce("_dst", column)).drop("_src", "_dst")


def resolved_moves(moves: DataFrame, closure: DataFrame) -> DataFrame:
    """The last move of each path, both ends resolved.  Incomplete moves are ignored."""
    sound = moves.where("path is not null and src is not null and dst is not null and src <> '' and dst <> ''")
    last = last_row_wins(sound, "path", ["seq"])
    return resolve(resolve(last, "src", closure), "dst", closure)


def apply_overlays(detections: DataFrame, closure: DataFrame, moves: DataFrame, removed: DataFrame, names: DataFrame) -> DataFrame:
    """``detections(path, face_id, ...)`` with merged, moved and named faces; removed ones dropped.

    Order: merges, then moves of (path, face), then removals of the outcome, then names (an id
    without a name is its own name).
    """
    merged = resolve(detections, "face_id", closure)
    moved = resolved_moves(moves, closure).select(F.col("path").alias("_path"), F.col("src").alias("_from"), F.col("dst").alias("_to"))
    placed = merged.join(moved, (merged["path"] == F.col("_path")) & (merged["face_id"] == F.col("_from")), "left")
    placed = placed.withColumn("face_id", F.coalesce("_to", "face_id")).drop("_path", "_from", "_to")
    gone = resolve(removed, "id", closure).select(F.col("id").alias("face_id"), "path").distinct()
    return placed.join(gone, ["path", "face_id"], "left_anti").join(names.select(F.col("id").alias("face_id"), "name"), "face_id", "left").withColumn("name", F.coalesce("name", "face_id"))


def cluster_images(members: DataFrame, merges: DataFrame, moves: DataFrame, removed: DataFrame) -> DataFrame:
    """``(id, path, seq, user_created, away, gone, moved_in)``: every image a cluster's view considers.

    Native clusters take in the images of clusters merged into them, skipped paths left out, then the
    images moved to them.  Targets of moves that are no native cluster are user-created; their skipped
    paths are left out too.  Merged clusters have no view of their own.
    """
    closure = merge_closure(merges)
    moves = graph.materialize(moves)
    native = members.select("id").distinct()
    shown = native.join(merges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    own = resolve(members, "id", closure).where(~paths.is_skipped(F.col("path"))).groupBy("id", "path").agg(F.min("seq").alias("seq"))
    own = own.join(shown, "id", "left_semi").withColumn("moved_in", F.lit(False))
    moved = resolved_moves(moves, closure)
    into = moved.select(F.col("dst").alias("id"), "path", (F.lit(1 << 40) + F.col("seq")).alias("seq"), F.lit(True).alias("moved_in"))
    into = into.join(native.withColumn("_native", F.lit(True)), "id", "left").join(merges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    into = into.where(F.col("_native").isNotNull() | ~paths.is_skipped(F.col("path"))).drop("_native")
    every = own.unionByName(into).groupBy("id", "path").agg(F.min("seq").alias("seq"), F.bool_or("moved_in").alias("moved_in"))
    away = moved.select(F.col("src").alias("id"), "path", F.lit(True).alias("away"))
    gone = resolve(removed, "id", closure).select("id", "path").distinct().withColumn("gone", F.lit(True))
    out = every.join(away, ["id", "path"], "left").join(gone, ["id", "path"], "left").join(native.withColumn("_native", F.lit(True)), "id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("id", "path", "seq", F.col("_native").isNull().alias("user_created"), flag("away"), flag("gone"), "moved_in")


def cluster_view(images: DataFrame, names: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row per cluster: name, counts before and after the overlays, active images in order."""
    active = ~F.col("gone") & ~(F.col("away") & ~F.col("user_created"))
    grouped = images.groupBy("id").agg(
        F.count_if(active).alias("count"), F.count("*").alias("original_count"), F.bool_or("user_created").alias("user_created"),
        F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(active, F.struct("seq", "path"))))), lambda r: r["path"]).alias("images"),
    )
    marked = grouped.join(names.select("id", "name"), "id", "left").join(skipped.select("id").distinct().withColumn("skipped", F.lit(True)), "id", "left")
    return marked.select("id", F.coalesce("name", F.lit("")).alias("name"), "count", "original_count", "images", F.coalesce("skipped", F.lit(False)).alias("skipped"), "user_created")


#: Fixed value: clusters on one page.
PAGE_SIZE = 24


def tab(view: DataFrame, name: str) -> DataFrame:
    """Tabs: ``named``, ``unnamed`` (not skipped), ``skipped``; anything else shows all."""
    return view.where({"named": "name <> ''", "unnamed": "name = '' and not skipped", "skipped": "skipped"}.get(name, "true"))


def _view_order(identity: str) -> list:
    return [F.asc("skipped"), (F.lit(identity == "") | (F.col("id") != identity)).asc(), F.desc("count"), F.asc("id")]


def in_view_order(view: DataFrame, identity: str = "") -> DataFrame:
    """Skipped last, the viewer's own cluster first, then by count; ties by id."""
    return view.orderBy(*_view_order(identity))


def with_rank(view: DataFrame, identity: str = "") -> DataFrame:
    """``view`` with ``rank``, each cluster's place in view order from 0; counted range by range."""
    order = F.struct("skipped", (F.lit(identity == "") | (F.col("id") != identity)).alias("other"), (-F.col("count")).alias("less"), "id")
    keyed = view.withColumn("_order", order)
    return keyed.join(graph.ranked(keyed.select("_order"), "_order"), "_order").drop("_order")


def page(view: DataFrame, number: int, identity: str = "", size: int = PAGE_SIZE) -> DataFrame:
    """One page in view order; the number is clamped to the pages there are."""
    last = max(0, (view.count() - 1) // size)
    return in_view_order(ranks.between(view, _view_order(identity), max(0, min(number, last)) * size, size), identity)


def cluster_stats(members: DataFrame, names: DataFrame, skipped: DataFrame, merges: DataFrame) -> DataFrame:
    """One row: clusters, displayed (all but merged), named, skipped, merges."""
    count = lambda df, alias, c="*": df.agg((F.count("*") if c == "*" else F.count_distinct(c)).alias(alias))
    one = count(members, "total", "id")
    for part in (count(names, "named"), count(skipped, "skipped"), count(merges, "merges")):
        one = one.crossJoin(part)  # one row each
    return one.select("total", (F.col("total") - F.col("merges")).alias("displayed"), "named", "skipped", "merges")


def named_clusters(members: DataFrame, names: DataFrame, merges: DataFrame) -> DataFrame:
    """Named, unmerged clusters with raw image counts, merged-in clusters included."""
    images = resolve(members.select("id", "path").distinct().withColumn("_own", F.col("id")), "id", merge_closure(merges))
    counted = images.groupBy("id").agg(F.count("*").alias("count"))
    shown = counted.join(merges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    return shown.join(names.where("name <> ''"), "id").select("id", "name", "count")


def next_user_id(used: DataFrame, prefix: str) -> str:
    """The smallest unused ``<prefix>_u<n>``, n from 1.

    Looks for the first gap after a used number, so only one row reaches the driver.
    """
    pattern = rf"^{prefix}_u([1-9]\d*)$"
    numbers = used.where(F.col("id").rlike(pattern)).select(F.regexp_extract("id", pattern, 1).cast("long").alias("n")).union(used.sparkSession.range(1).select(F.col("id").alias("n"))).distinct()
    following = numbers.select((F.col("n") + 1).alias("n")).join(numbers, "n", "left_anti")
    return f"{prefix}_u{following.agg(F.min('n')).first()[0]}"


#: State of an overlay log: for each kind of entry, its key columns.
_KEYS = {"name": ["id"], "skip": ["id"], "merge": ["id"], "remove": ["id", "path"], "move": ["path"], "thumb": ["id"]}


def log_state(log: DataFrame, entry: str) -> DataFrame:
    """Current rows of one kind of entry in ``log(seq, entry, id, path, value)``.

    The last event of a key counts; a null or empty value clears it (unname, unskip, unmerge,
    restore, unmove).
    """
    keys = _KEYS[entry]
    rows = log.where(F.col("entry") == entry).groupBy(*keys).agg(F.max_by(F.struct("seq", "value", *[c for c in ("id", "path") if c not in keys]), "seq").alias("r"))
    flat = rows.select(*keys, *[F.col(f"r.{c}").alias(c) for c in ("id", "path") if c not in keys], "r.value", "r.seq")
    return flat.where("value is not null and value <> ''").select("id", "path", "value", "seq")


def _events(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "seq long, entry string, id string, path string, value string")


def _chains(merges: DataFrame, ids: list[str]) -> dict[str, str]:
    """The merges met on the way from ``ids``, as a mapping; a query for each further step."""
    found: dict[str, str] = {}
    front = set(ids)
    while front:
        step = {r["src"]: r["dst"] for r in merges.where(F.col("src").isin(sorted(front))).collect()}
        found |= step
        front = set(step.values()) - found.keys()
    return found


def merge_events(merges: DataFrame, names: DataFrame, sources: list[str], target: str, seq: int) -> DataFrame:
    """Log rows for merging ``sources`` into ``target``.

    The target is resolved first.  A source that is that end, or already leads to it, is left out.
    Every other source takes the end's name, if it has one.  Empty sources or targets do nothing.
    """
    spark = merges.sparkSession
    chain = _chains(merges, [x for x in [target, *sources] if x])

    def end_of(node: str) -> str:
        met = set()
        while node in chain and node not in met:
            met.add(node)
            node = chain[node]
        return node

    final, rows = end_of(target) if target else None, []
    name = next((r["name"] for r in names.where((F.col("id") == final) & (F.col("name") != "")).limit(1).collect()), None)
    for source in sources if target else []:
        if not source or source == final or end_of(source) == final:
            continue
        chain[source] = final
        rows.append((seq + len(rows), "merge", source, None, final))
        if name:
            rows.append((seq + len(rows), "name", source, None, name))
    return _events(spark, rows)


def clear_events(spark, entry: str, ids: list[str], seq: int, path: str | None = None) -> DataFrame:
    """Log rows that take entries back: unmerge, unname, unskip, unmove, restore a removed image."""
    return _events(spark, [(seq + i, entry, x, path, None) for i, x in enumerate(ids) if x])


def skip_events(skipped: DataFrame, ids: list[str], seq: int) -> DataFrame:
    """Log rows that skip ``ids``; those skipped before are left out, so repeating adds nothing."""
    wanted = list(dict.fromkeys(x for x in ids if x))
    known = {r["id"] for r in skipped.where(F.col("id").isin(wanted)).select("id").collect()}
    return _events(skipped.sparkSession, [(seq + i, "skip", x, None, "1") for i, x in enumerate(w for w in wanted if w not in known)])


def skip_toggle(skipped: DataFrame, cluster: str, seq: int) -> DataFrame:
    """A log row that skips a cluster, or takes that back if it is skipped."""
    held = not skipped.where(F.col("id") == cluster).isEmpty()
    return _events(skipped.sparkSession, [(seq, "skip", cluster, None, None if held else "1")] if cluster else [])


def name_events(spark, named: dict[str, str], seq: int) -> DataFrame:
    """Log rows that name clusters; a blank name clears it."""
    return _events(spark, [(seq + i, "name", k, None, v.strip() or None) for i, (k, v) in enumerate(named.items()) if k])


def remove_events(spark, cluster: str, paths_: list[str], seq: int) -> DataFrame:
    """Log rows that take images out of a cluster's view."""
    return _events(spark, [(seq + i, "remove", cluster, p, "1") for i, p in enumerate(paths_) if p and cluster])


def thumbnail_event(perms: DataFrame, cluster: str, path: str, seq: int) -> DataFrame:
    """A log row that chooses a cluster's image, if the one viewer in ``perms`` may; else none."""
    from . import access

    may = not perms.limit(1).where(access.may_set_thumbnail(F.lit(cluster))).isEmpty()
    return _events(perms.sparkSession, [(seq, "thumb", cluster, None, path)] if may and cluster and path else [])


def append_events(events: DataFrame, path: str) -> None:
    """Append log rows to the overlay log at ``path``."""
    events.coalesce(1).write.mode("append").parquet(path)


def read_events(spark, path: str) -> DataFrame:
    from ..sources.tables import read_parquet

    return read_parquet(spark, path, "seq long, entry string, id string, path string, value string")


def viewer_view(images: DataFrame, names: DataFrame, skipped: DataFrame, faces: DataFrame, perms: DataFrame, kind: str) -> DataFrame:
    """The cluster view of the one viewer in ``perms``: hidden images go, then empty clusters.

    ``faces(path, face_ids)`` are the effective faces of images; pet clusters (``kind='pet'``) do not
    ask for them.  ``images`` as from :func:`cluster_images`.
    """
    from . import access

    rows = images.join(faces, "path", "left").crossJoin(F.broadcast(perms.limit(1)))  # one row
    seen = access.can_see_in_pet_cluster(F.col("id"), F.col("path")) if kind == "pet" else access.can_see_in_face_cluster(F.col("id"), F.col("path"), F.coalesce("face_ids", F.array().cast("array<string>")))
    return cluster_view(rows.where(seen).select(*images.columns), names, skipped).where("count > 0")


def effective_faces(members: DataFrame, merges: DataFrame, moves: DataFrame) -> DataFrame:
    """``(path, face_ids)`` after merges and moves, as visibility in cluster views asks for them."""
    closure = merge_closure(merges)
    moved = resolved_moves(moves, closure).select("path", F.col("src").alias("id"), F.col("dst").alias("_to"))
    placed = resolve(members, "id", closure).join(moved, ["path", "id"], "left").withColumn("id", F.coalesce("_to", "id"))
    return placed.groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("face_ids"))


def combined_view(faces: DataFrame, pets: DataFrame) -> DataFrame:
    """Face and pet clusters in one list, each tagged with its kind."""
    return faces.withColumn("kind", F.lit("face")).unionByName(pets.withColumn("kind", F.lit("pet")))


def thumbnail_faces(detections: DataFrame, chosen: DataFrame, merges: DataFrame) -> DataFrame:
    """``(id, path, seq)``: in each cluster's chosen image, its first detection.

    A detection belongs if its face is the cluster or was merged into it.  ``chosen(id, path)``.
    """
    placed = resolve(detections, "face_id", merge_closure(merges)).select(F.col("face_id").alias("id"), "path", "seq")
    return chosen.join(placed, ["id", "path"]).groupBy("id", "path").agg(F.min("seq").alias("seq"))


def viewer_stats(names: DataFrame, perms: DataFrame) -> DataFrame:
    """Counts for a viewer's faces: total and displayed are the allowed faces, named those with a name."""
    allowed = perms.limit(1).select(F.explode("allowed_faces").alias("id"))
    known = allowed.join(names.where("name <> ''").select("id", F.lit(1).alias("named")), "id", "left")
    return known.agg(F.count("*").alias("total"), F.count("*").alias("displayed"), F.count("named").alias("named")).select("*", F.lit(0).cast("long").alias("skipped"), F.lit(0).cast("long").alias("merges"))


def sum_stats(parts: list[DataFrame]) -> DataFrame:
    """Statistics of several kinds of clusters, added up."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.agg(*[F.sum(c).alias(c) for c in every.columns])


def cluster_metadata(images: DataFrame, files: DataFrame, cluster: str, perms: DataFrame | None = None) -> DataFrame:
    """Images of one cluster with year and month of their file time, active ones first, newest first.

    ``files(path, modified)``; images without a file come last, without a date.  ``removed`` tells
    the lists apart; only an admin in ``perms`` (one row) gets the removed ones.
    """
    own = images.where((F.col("id") == cluster) & ~(F.col("away") & ~F.col("user_created")))
    if perms is None or perms.limit(1).where("is_admin").isEmpty():
        own = own.where("not gone")
    dated = own.join(files.select("path", "modified"), "path", "left")
    listed = dated.select("path", "modified", F.year("modified").alias("year"), F.month("modified").alias("month"), F.col("gone").alias("removed"))
    return listed.orderBy("removed", F.desc_nulls_last("modified"), "path")


def move_events(paths_: list[str], source: str, target: str, used: DataFrame, seq: int, prefix: str = "face", name: str = "") -> DataFrame:
    """Log rows that move ``paths_`` out of ``source``; the target ``__new__`` makes a new cluster.

    A new cluster takes ``name`` if it is not blank.  A move replaces an earlier one of its path.
    Nothing moves from a cluster to itself.
    """
    end, rows = target, []
    if target == "__new__":
        end = next_user_id(used, prefix)
        if name.strip():
            rows.append((seq, "name", end, None, name.strip()))
    if source and end and source != end:
        rows += [(seq + len(rows) + i, "move", source, p, end) for i, p in enumerate(x for x in paths_ if x)]
    return _events(used.sparkSession, rows)
