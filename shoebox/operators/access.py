"""Who sees what: permissions, three visibility predicates, and names as a viewer knows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths

#: Family edges "from is the <type> of to" -> (from as to sees it, to as from sees it).
FAMILY = {
    "父": ("爸爸", "子女"), "母": ("媽媽", "子女"), "夫": ("丈夫", "妻子"), "妻": ("妻子", "丈夫"),
    "兄": ("哥哥", "弟妹"), "姐": ("姐姐", "弟妹"), "弟": ("弟弟", "兄姐"), "妹": ("妹妹", "兄姐"),
    "爺爺": ("爺爺", "孫子女"), "奶奶": ("奶奶", "孫子女"), "外公": ("外公", "外孫子女"), "外婆": ("外婆", "外孫子女"),
}
SELF = "我"


def permissions(users: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per user: ``name, is_admin, identity, allowed_faces, allowed_pets, blocked_paths``.

    Arrays are unions over the user's groups, distinct and sorted; the identity counts as an allowed
    face.  Admins have empty arrays, for nothing is asked of them.
    """
    base = users.select("name", (F.col("role") == "admin").alias("is_admin"), F.trim(F.coalesce("identity", F.lit(""))).alias("identity"), F.explode_outer("groups").alias("group"))
    joined = base.join(groups.withColumnRenamed("name", "group"), "group", "left")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    merged = joined.groupBy("name", "is_admin", "identity").agg(*[union(c).alias(c) for c in ("allowed_faces", "allowed_pets", "blocked_paths")])
    none = F.array().cast("array<string>")
    faces = F.when(F.col("identity") != "", F.array_sort(F.array_union("allowed_faces", F.array("identity")))).otherwise(F.col("allowed_faces"))
    held = lambda c: F.when(F.col("is_admin"), none).otherwise(c)
    return merged.select("name", "is_admin", "identity", held(faces).alias("allowed_faces"), held(F.col("allowed_pets")).alias("allowed_pets"), held(F.col("blocked_paths")).alias("blocked_paths"))


def can_see(path: Column, faces: Column, pets: Column | None = None, perms: str = "") -> Column:
    """Photo visibility; the first rule that applies decides.

    Admin; the viewer's own face; pets (an empty list of allowed pets shares all); blocked paths;
    an allowed face; else hidden.  ``perms`` prefixes the permission columns; a row without
    permissions (unknown user) sees nothing.
    """
    p = lambda c: F.col(perms + c)
    own = (p("identity") != "") & F.array_contains(faces, p("identity"))
    shared = F.lit(False) if pets is None else (F.size(pets) > 0) & ((F.size(p("allowed_pets")) == 0) | F.arrays_overlap(pets, p("allowed_pets")))
    no = F.lit(False)
    return F.coalesce(
        F.when(p("is_admin"), True).when(F.coalesce(own, no), True).when(F.coalesce(shared, no), True)
        .when(paths.blocked(path, p("blocked_paths")), False).when(F.coalesce(F.arrays_overlap(faces, p("allowed_faces")), no), True).otherwise(False),
        no,
    )


def can_see_in_face_cluster(cluster: Column, path: Column, faces: Column, perms: str = "") -> Column:
    """In a face cluster's view: the cluster must be allowed, and pets open nothing."""
    p = lambda c: F.col(perms + c)
    return F.coalesce(F.when(p("is_admin"), True).otherwise(F.array_contains(p("allowed_faces"), cluster) & can_see(path, faces, None, perms)), F.lit(False))


def can_see_in_pet_cluster(cluster: Column, path: Column, perms: str = "") -> Column:
    """In a pet cluster's view: listed pets open blocked paths, unlisted ones are hidden; without a
    list only blocked paths are hidden."""
    p = lambda c: F.col(perms + c)
    listed = F.array_contains(p("allowed_pets"), cluster)
    return F.coalesce(F.when(p("is_admin"), True).when(F.size(p("allowed_pets")) > 0, listed).otherwise(~paths.blocked(path, p("blocked_paths"))), F.lit(False))


def can_see_cluster(cluster: Column, perms: str = "") -> Column:
    return F.coalesce(F.col(perms + "is_admin") | F.array_contains(F.col(perms + "allowed_faces"), cluster), F.lit(False))


def aliases(edges: DataFrame) -> DataFrame:
    """``(viewer, target, alias)`` from ``edges(seq, src, dst, type, alias_from, alias_to)``.

    Only family types count.  ``alias_to`` overrides what dst calls src, ``alias_from`` what src
    calls dst.  Where edges disagree the later one holds.
    """
    rules = edges.sparkSession.createDataFrame([(t, a, b) for t, (a, b) in FAMILY.items()], "type string, forward string, backward string")
    said = lambda given, usual: F.coalesce(F.nullif(F.col(given), F.lit("")), F.col(usual))
    sound = edges.where("src <> '' and dst <> '' and type <> ''").join(F.broadcast(rules), "type")  # rules: a fixed dozen rows
    both = sound.select(F.inline(F.array(
        F.struct((F.col("seq") * 2).alias("order"), F.col("dst").alias("viewer"), F.col("src").alias("target"), said("alias_to", "forward").alias("alias")),
        F.struct((F.col("seq") * 2 + 1).alias("order"), F.col("src").alias("viewer"), F.col("dst").alias("target"), said("alias_from", "backward").alias("alias")),
    )))
    return both.groupBy("viewer", "target").agg(F.max_by("alias", "order").alias("alias"))


def clean_edges(edges: DataFrame, other_types: tuple[str, ...]) -> DataFrame:
    """Edges worth saving, trimmed: two different ends and a known or custom, non-empty type."""
    trimmed = edges.withColumns({c: F.trim(c) for c in ("src", "dst", "type")} | {c: F.nullif(F.trim(c), F.lit("")) for c in ("alias_from", "alias_to") if c in edges.columns})
    return trimmed.where("src <> '' and dst <> '' and src <> dst and type <> ''").withColumn("family", F.col("type").isin(*FAMILY)).withColumn("listed", F.col("type").isin(*FAMILY, *other_types))


def display_names(people: DataFrame, known: DataFrame, viewer: str) -> DataFrame:
    """``people(id, name)`` with ``shown``: the viewer's alias, else 我 for itself, else the name."""
    mine = known.where(F.col("viewer") == viewer).select(F.col("target").alias("id"), "alias")
    itself = (F.col("id") == viewer) & F.lit(viewer != "")
    return people.join(mine, "id", "left").select("id", "name", F.coalesce("alias", F.when(itself, SELF), "name").alias("shown"))


def admins_left(users: DataFrame, without: str) -> DataFrame:
    """Number of admins if ``without`` were removed; writes that would leave none must be refused."""
    return users.where((F.col("role") == "admin") & (F.col("name") != without)).agg(F.count("*").alias("admins"))


def may_set_thumbnail(cluster: Column, perms: str = "") -> Column:
    """Admins may for any cluster, others only for their own face."""
    identity = F.col(perms + "identity")
    return F.coalesce(F.col(perms + "is_admin") | ((identity != "") & (identity == cluster)), F.lit(False))


def clean_graph(nodes: DataFrame, edges: DataFrame, positions: DataFrame, other_types: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A relationship graph worth saving: ``nodes(id)``, ``edges`` as above, ``positions(id, x, y)``.

    Blank and repeated nodes go; positions stay only for nodes that stay, with both numbers there.
    """
    kept = nodes.select(F.trim("id").alias("id")).where("id <> ''").distinct()
    placed = positions.where("x is not null and y is not null").join(kept, "id", "left_semi").select("id", F.col("x").cast("double"), F.col("y").cast("double"))
    return kept, clean_edges(edges, other_types), placed


def save_graph(nodes: DataFrame, edges: DataFrame, positions: DataFrame, other_types: tuple[str, ...], folder: str) -> DataFrame:
    """Write the cleaned graph and the aliases it yields below ``folder``; one row of totals."""
    kept = clean_graph(nodes, edges, positions, other_types)
    for name, part in zip(("nodes", "edges", "positions", "aliases"), (*kept, aliases(kept[1]))):
        part.write.mode("overwrite").parquet(f"{folder}/{name}")
    return graph_totals(*kept[:2])


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and aliases that the edges yield."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(nodes, "nodes").crossJoin(count(edges, "edges")).crossJoin(count(aliases(edges), "aliases"))  # one row each


class Refused(ValueError):
    """A write that a guard forbids."""


ROLES = ("admin", "viewer")


def put_user(users: DataFrame, name: str, role: str, groups: list[str], identity: str = "") -> DataFrame:
    """Users with one created or changed; the last admin keeps the role, names and roles must be sound."""
    if not name.strip() or role not in ROLES:
        raise Refused("a user needs a name and a known role")
    if role != "admin":
        _keep_an_admin(users, name)
    row = users.sparkSession.createDataFrame([(name, role, identity, groups)], users.select("name", "role", "identity", "groups").schema)
    return users.where(F.col("name") != name).select("name", "role", "identity", "groups").unionByName(row)


def drop_user(users: DataFrame, name: str) -> DataFrame:
    """Users without one; the last admin cannot go."""
    _keep_an_admin(users, name)
    return users.where(F.col("name") != name)


def _keep_an_admin(users: DataFrame, name: str) -> None:
    is_admin = not users.where((F.col("name") == name) & (F.col("role") == "admin")).isEmpty()
    if is_admin and not admins_left(users, name).first()["admins"]:
        raise Refused(f"{name} is the last admin")


def put_group(groups: DataFrame, name: str, allowed_faces: list[str], allowed_pets: list[str], blocked_paths: list[str]) -> DataFrame:
    """Groups with one created or replaced; lists lose blanks and repeats."""
    if not name.strip():
        raise Refused("a group needs a name")
    clean = lambda xs: list(dict.fromkeys(x.strip() for x in xs if x.strip()))
    row = groups.sparkSession.createDataFrame([(name, clean(allowed_faces), clean(allowed_pets), clean(blocked_paths))], groups.schema)
    return groups.where(F.col("name") != name).unionByName(row)


def drop_group(users: DataFrame, groups: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Users and groups after deleting a group; it also leaves every user's list."""
    return users.withColumn("groups", F.array_remove("groups", name)), groups.where(F.col("name") != name)
