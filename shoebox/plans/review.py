"""Review decisions as set-based changes over the face workspace.

Every decision takes a table of commands, so one call may decide one cluster
or millions. A checked decision writes the rows it changed to the shared
folder, as a layer over each table, and returns the workspace that reads
through them; with ``check=False`` it only returns plans. Before-images are
kept one row per changed row; they name the keys a decision touches, so what
is written, by an undo too, grows with the decision and not with the tables.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schemas
from ..functions import keys
from ..functions.hashing import person_id_from_name_key, set_digest
from ..functions.text import first_name, name_key
from ..operators import workspace as reads
from ..operators.agglomerate import member_digest
from ..operators.layers import Layered
from ..operators.tables import delete_keys, insert_missing, patch, upsert
from ..session import cut_lineage

IMAGES = T.StructType(
    [
        T.StructField("action_id", T.LongType(), True),
        T.StructField("table_name", T.StringType(), True),
        T.StructField("undo", T.StringType(), True),  # restore | delete
        T.StructField("key", T.StringType(), True),
        T.StructField("row_json", T.StringType(), True),
    ]
)
_JSON = {"ignoreNullFields": "false"}


class ReviewConflict(ValueError):
    """The decision contradicts the present state; nothing was changed."""


@dataclass(frozen=True)
class Outcome:
    """The action that holds a decision, if it changed anything; of an earlier call when replayed."""

    action_id: int | None
    replayed: bool = False


@dataclass(frozen=True)
class Workspace:
    pictures: DataFrame
    people: DataFrame
    clusters: DataFrame
    faces: DataFrame
    cannot_links: DataFrame
    suggestions: DataFrame
    actions: DataFrame
    images: DataFrame
    #: How the tables that decisions have changed are layered, by name.
    layers: Mapping[str, Layered] = field(default_factory=dict)


def _refuse(rows: DataFrame, message: str) -> None:
    found = rows.head(1)
    if found:
        raise ReviewConflict(f"{message}: {found[0][0]}")


def _require_clusters(ws: Workspace, commands: DataFrame) -> None:
    known = ws.clusters.select(F.col("id").alias("cluster_id"))
    _refuse(commands.join(known, "cluster_id", "left_anti").select("cluster_id"), "cluster not found")


# State -----------------------------------------------------------------------

def cluster_state(faces: DataFrame) -> DataFrame:
    """What each cluster's faces imply: status, person and representative.

    One map-side combined aggregate per cluster. All labelable faces labeled
    with one person: labeled. Some labelable face otherwise: unreviewed. None
    labelable: unknown if any face is, else ignored.
    """
    open_ = reads.labelable(F.col("status"))
    named = open_ & (F.col("status") == "labeled") & F.col("person_id").isNotNull()
    pool = F.when(open_, 0).when(F.col("status") == "unknown", 1).otherwise(2)
    facts = (
        faces.where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(
            F.count_if(open_).alias("n_open"),
            F.count_if(named).alias("n_named"),
            F.count_if(F.col("status") == "unknown").alias("n_unknown"),
            F.min(F.when(named, F.col("person_id"))).alias("lo"),
            F.max(F.when(named, F.col("person_id"))).alias("hi"),
            F.min_by("id", F.struct(pool, -F.col("quality_score"), "id")).alias("representative_face_id"),
        )
    )
    agreed = (F.col("n_named") == F.col("n_open")) & (F.col("lo") == F.col("hi"))
    status = (
        F.when(F.col("n_open") == 0, F.when(F.col("n_unknown") > 0, "unknown").otherwise("ignored"))
        .when(agreed, "labeled")
        .otherwise("unreviewed")
    )
    return facts.select(
        "cluster_id", status.alias("status"),
        F.when(status == "labeled", F.col("lo")).alias("person_id"),
        "representative_face_id",
    )


def recompute_clusters(clusters: DataFrame, faces: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """Bring touched clusters in line with their faces; empty ones disappear."""
    ids = touched.select("cluster_id").distinct()
    state = cluster_state(faces.join(ids, "cluster_id", "left_semi"))
    changes = ids.join(state, "cluster_id", "left").withColumnRenamed("cluster_id", "id")
    # One join: a second one for the empty clusters would aggregate the faces again.
    return patch(
        clusters, changes, "id",
        {
            "status": F.col("_c.status"), "person_id": F.col("_c.person_id"),
            "representative_face_id": F.col("_c.representative_face_id"),
            "reviewed_at": F.when(F.col("_c.status") != "unreviewed", now),
            "revision": F.col("revision") + 1, "updated_at": now,
        },
        gone=F.col("_c.representative_face_id").isNull(),
    )


def _set_faces(faces: DataFrame, changes: DataFrame, now: Column, **extra: Column) -> DataFrame:
    """Apply (id, status, person_id) to faces, bumping their revision."""
    return patch(
        faces, changes, "id",
        {
            "status": F.col("_c.status"), "person_id": F.col("_c.person_id"),
            "revision": F.col("revision") + 1, "updated_at": now, **extra,
        },
    )


# Before-images and the action log ---------------------------------------------

def _image(rows: DataFrame, table: str, key: str, columns: tuple[str, ...], undo: str = "restore") -> DataFrame:
    payload = F.to_json(F.struct(*columns), _JSON) if undo == "restore" else F.lit(None).cast("string")
    return rows.select(
        F.lit(table).alias("table_name"), F.lit(undo).alias("undo"),
        F.col(key).alias("key"), payload.alias("row_json"),
    )


def face_images(ws: Workspace, cluster_ids: DataFrame) -> DataFrame:
    rows = ws.faces.join(cluster_ids.select("cluster_id").distinct(), "cluster_id", "left_semi")
    return _image(rows, "faces", "id", schemas.MUTABLE_FACE_COLUMNS)


def cluster_images(ws: Workspace, cluster_ids: DataFrame) -> DataFrame:
    ids = cluster_ids.select(F.col("cluster_id").alias("id")).distinct()
    return _image(ws.clusters.join(ids, "id", "left_semi"), "clusters", "id", schemas.MUTABLE_CLUSTER_COLUMNS)


def _touching(suggestions: DataFrame, cluster_ids: DataFrame) -> DataFrame:
    """Suggestions with either end in the set, each once."""
    ids = cluster_ids.select("cluster_id").distinct()
    keys = (
        reads.neighbours(suggestions.select("cluster_id_a", "cluster_id_b"))
        .join(ids, "cluster_id", "left_semi")
        .select(
            F.least("cluster_id", "other_id").alias("cluster_id_a"),
            F.greatest("cluster_id", "other_id").alias("cluster_id_b"),
        )
        .distinct()
    )
    return suggestions.join(keys, ["cluster_id_a", "cluster_id_b"], "left_semi")


def suggestion_images(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("_key", F.concat_ws("|", "cluster_id_a", "cluster_id_b"))
    return _image(keyed, "suggestions", "_key", tuple(schemas.SUGGESTIONS.names))


def already_done(ws: Workspace, mutation_id: str) -> int | None:
    """Action id of an earlier call with this mutation id, which must be well formed."""
    if not re.fullmatch(keys.MUTATION_ID, mutation_id):
        raise ReviewConflict("a mutation id has 8 to 100 letters, digits, dashes or underscores")
    row = ws.actions.where(F.col("client_mutation_id") == mutation_id).select(F.min("id")).head()
    return row[0]


def outcome(before: Workspace, after: Workspace, mutation_id: str) -> Outcome:
    """What became of a checked decision: one that changes nothing returns the workspace it got."""
    action = already_done(after, mutation_id)
    return Outcome(action, replayed=action is not None and after is before)


def command_payload(commands: DataFrame, **parameters: str) -> DataFrame:
    """One row that tells a list of commands of any length: its size, its digest, the parameters."""
    whole = set_digest(commands, sorted(commands.columns), alias="digest").crossJoin(
        F.broadcast(commands.agg(F.count(F.lit(1)).alias("commands")))
    )
    given = [F.lit(v).alias(k) for k, v in parameters.items()]
    return whole.select(F.to_json(F.struct(*given, "commands", "digest")).alias("payload_json"))


def append_action(
    ws: Workspace, action_type: str, mutation_id: str, payload: DataFrame, images: DataFrame, now: Column
) -> Workspace:
    """Log the action under the next id with its payload, one row, and its before-images."""
    one = ws.actions.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = one.crossJoin(F.broadcast(payload)).select(
        "id", F.lit(mutation_id).alias("client_mutation_id"), F.lit(action_type).alias("action_type"),
        "payload_json", F.lit(None).cast("string").alias("inverse_json"),
        now.cast("string").alias("created_at"), F.lit(None).cast("string").alias("undone_at"),
    )
    tagged = images.crossJoin(F.broadcast(one.withColumnRenamed("id", "action_id")))
    return replace(
        ws,
        actions=ws.actions.unionByName(row.select(*ws.actions.columns)),
        images=ws.images.unionByName(tagged.select(*IMAGES.names)),
    )


def high_watermark(ws: Workspace) -> DataFrame:
    return ws.actions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("action_high_watermark"))


#: The keys of the tables that decisions change; before-images name rows by them.
KEYS = {
    "faces": ("id",), "clusters": ("id",), "people": ("id",), "suggestions": ("cluster_id_a", "cluster_id_b"),
    "cannot_links": ("face_id_a", "face_id_b"), "actions": ("id",),
}


def changing_columns(name: str, table: DataFrame) -> tuple[str, ...]:
    """Decisions change these columns of faces and never add nor drop one; other tables change as rows."""
    return tuple(c for c in schemas.MUTABLE_FACE_COLUMNS if c != "id" and c in table.columns) if name == "faces" else ()


def settled(
    before: Workspace, after: Workspace, touched: DataFrame | None, action: DataFrame, images: DataFrame | None = None,
    faces: DataFrame | None = None,
) -> Workspace:
    """Write what a decision changed, so the next one starts from data.

    touched: (table_name, key) of the rows it may have changed, as its images
    name them; None: as the images written here do. action: the ids of the
    actions written or marked. images: the before-images it adds. faces: the
    changed faces with their changing columns, if they are known as rows.
    """
    layers, tables = dict(before.layers), {}
    if images is not None:
        layers["images"] = layers.get("images", Layered(before.images)).appended(images)
        tables["images"] = layers["images"].view()
        if touched is None:
            ids = F.broadcast(action.select(F.col("id").alias("action_id")))
            touched = layers["images"].last().select("_row.*") if layers["images"].paths else tables["images"].join(ids, "action_id", "left_semi")
    for name, key in KEYS.items():
        new = getattr(after, name)
        if new is getattr(before, name):
            continue
        keys = action.select(F.col("id").cast("string").alias("key")) if name == "actions" else touched.where(F.col("table_name") == name).select("key")
        layer = layers.get(name) or Layered(getattr(before, name), key, changing=changing_columns(name, getattr(before, name)))
        layers[name] = layer.patched(faces) if name == "faces" and faces is not None else layer.changed(new, keys)
        tables[name] = layers[name].view()
    return replace(after, layers=layers, **tables)


def _log(before, after, action_type, mutation_id, payload, images, now, write, faces=None) -> Workspace:
    out = images[0]
    for more in images[1:]:
        out = out.unionByName(more)
    if not write:
        return append_action(after, action_type, mutation_id, payload, out, now)
    logged = append_action(after, action_type, mutation_id, payload, out, now)
    added = cut_lineage(logged.actions.where(F.col("client_mutation_id") == mutation_id).select("id"), "action")
    tagged = out.crossJoin(F.broadcast(added.withColumnRenamed("id", "action_id"))).select(*IMAGES.names)
    return settled(before, logged, None, added, tagged, faces)


def _taken(ws: Workspace, target: DataFrame, write: bool) -> DataFrame:
    """The faces of some clusters, (cluster_id unique, more columns), as far as decisions read them.

    Written once, in narrow rows, where the decision is: its images, its layer
    and the new state of its clusters all come from these rows without another
    shuffle of the faces.
    """
    own = [c for c in schemas.MUTABLE_FACE_COLUMNS if c in ws.faces.columns]
    rows = ws.faces.select(*own, "quality_score").join(target, "cluster_id")
    return cut_lineage(rows, "taken", "zstd") if write else rows


def _face_rows(rows: DataFrame) -> DataFrame:
    return _image(rows, "faces", "id", schemas.MUTABLE_FACE_COLUMNS)


def _decided(taken: DataFrame, hit: Column, status: Column, person: Column, now: Column) -> DataFrame:
    """The taken faces as they are after the decision; _hit tells which it changes."""
    hit = F.coalesce(hit, F.lit(False))
    new = {"status": status, "person_id": person, "revision": F.col("revision") + 1, "updated_at": now}
    changed = {c: F.when(hit, v).otherwise(F.col(c)).cast(taken.schema[c].dataType).alias(c) for c, v in new.items() if c in taken.columns}
    kept = [c for c in (*schemas.MUTABLE_FACE_COLUMNS, "quality_score") if c in taken.columns]
    return taken.select(*[changed.get(c, F.col(c)) for c in kept], hit.alias("_hit"))


# Decisions --------------------------------------------------------------------

def named_commands(commands: DataFrame, *, aliases: dict[str, str] | None = None, normalize: bool = True) -> DataFrame:
    """(cluster_id, name) to (cluster_id, display_name, name_key)."""
    display = first_name(F.col("name"), aliases=aliases, normalize=normalize)
    return commands.select("cluster_id", display.alias("display_name")).withColumn(
        "name_key", name_key(F.col("display_name"))
    )


def find_or_create_people(people: DataFrame, named: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(all people, created people). A new id is derived from the name key."""
    wanted = named.groupBy("name_key").agg(F.min("display_name").alias("display_name"))
    missing = wanted.join(people.select("name_key"), "name_key", "left_anti")
    created = missing.select(
        person_id_from_name_key(F.col("name_key")).alias("id"), "display_name", "name_key",
        now.cast("string").alias("created_at"), now.cast("string").alias("updated_at"),
    )
    return people.unionByName(created.select(*people.columns)), created


def label_clusters(
    ws: Workspace, commands: DataFrame, *, mutation_id: str, now: Column,
    aliases: dict[str, str] | None = None, normalize: bool = True, check: bool = True,
) -> Workspace:
    """Name clusters. Faces follow unless ignored or unknown; in an unknown
    cluster the unknown faces follow too. Clusters already so named are left
    alone."""
    if check and already_done(ws, mutation_id) is not None:
        return ws
    _refuse(
        commands.groupBy("cluster_id").count().where("count > 1").select("cluster_id"), "a cluster can be named once per command list"
    )
    named = named_commands(commands, aliases=aliases, normalize=normalize)
    if check:
        # Names are normalised once, not per reader of the list.
        named = cut_lineage(named, "named")
        _require_clusters(ws, commands)
        _refuse(named.where(F.col("display_name").isNull()).select("cluster_id"), "name must be 1 to 120 characters")
    people, created = find_or_create_people(ws.people, named, now)
    target = (
        named.join(people.select("name_key", F.col("id").alias("new_person")), "name_key")
        .join(
            ws.clusters.select(
                F.col("id").alias("cluster_id"), F.col("status").alias("cluster_status"),
                F.col("person_id").alias("cluster_person"),
            ),
            "cluster_id",
        )
        .select("cluster_id", "new_person", "cluster_status", "cluster_person")
    )
    placed = _taken(ws, target, check)
    eligible = (F.col("status") != "ignored") & (
        (F.col("cluster_status") == "unknown") | (F.col("status") != "unknown")
    )
    settled = ~reads.labelable(F.col("status")) | (
        (F.col("status") == "labeled") & F.col("person_id").eqNullSafe(F.col("new_person"))
    )
    summary = placed.groupBy("cluster_id").agg(
        F.count_if(eligible).alias("eligible"), F.count_if(~settled).alias("unsettled")
    )
    same = (F.col("cluster_status") == "labeled") & (F.col("cluster_person") == F.col("new_person"))
    todo = (
        target.join(summary, "cluster_id", "left")
        .where(~(F.coalesce(same, F.lit(False)) & (F.coalesce("unsettled", F.lit(0)) == 0)))
    )
    if check:
        todo = cut_lineage(todo, "todo")
        _refuse(
            todo.where(F.coalesce("eligible", F.lit(0)) == 0).select("cluster_id"),
            "recover at least one face before naming this cluster",
        )
        if todo.isEmpty():
            return ws
    touched = todo.select("cluster_id")
    named_faces = placed.join(touched, "cluster_id", "left_semi")
    images = [_face_rows(named_faces), cluster_images(ws, touched), _image(created, "people", "id", (), "delete")]
    after = _decided(named_faces, eligible, F.lit("labeled"), F.col("new_person"), now)
    changes = named_faces.where(eligible).select("id", F.lit("labeled").alias("status"), F.col("new_person").alias("person_id"))
    out = replace(
        ws, people=people, faces=_set_faces(ws.faces, changes, now), clusters=recompute_clusters(ws.clusters, after, touched, now)
    )
    return _log(ws, out, "label_cluster", mutation_id, command_payload(commands), images, now, check, after.where("_hit"))


def batch_label(
    ws: Workspace, commands: DataFrame, *, mutation_id: str, now: Column, check: bool = True
) -> Workspace:
    """Give unreviewed clusters an existing person; all commands or none."""
    if check and already_done(ws, mutation_id) is not None:
        return ws
    target = commands.select("cluster_id", F.col("person_id").alias("new_person"))
    state = target.join(
        ws.clusters.select(
            F.col("id").alias("cluster_id"), F.col("status").alias("cluster_status"),
            F.col("person_id").alias("cluster_person"),
        ),
        "cluster_id",
    )
    if check:
        _require_clusters(ws, commands)
        unknown_people = target.join(ws.people.select(F.col("id").alias("new_person")), "new_person", "left_anti")
        _refuse(unknown_people.select("new_person"), "person not found")
        _refuse(
            target.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("cluster_id"),
            "cluster ids must be unique",
        )
        _refuse(
            state.where(F.col("cluster_status").isin("ignored", "unknown")).select("cluster_id"),
            "recover ignored or unknown clusters first",
        )
        _refuse(
            state.where(
                (F.col("cluster_status") == "labeled") & ~F.col("cluster_person").eqNullSafe(F.col("new_person"))
            ).select("cluster_id"),
            "cluster belongs to another person",
        )
    placed = _taken(ws, state.select("cluster_id", "new_person", "cluster_status"), check)
    if check:
        has_open = placed.where(reads.labelable(F.col("status"))).select("cluster_id")
        _refuse(target.join(has_open, "cluster_id", "left_anti").select("cluster_id"), "recover at least one face first")
        _refuse(
            placed.where(
                (F.col("status") == "labeled") & ~F.col("person_id").eqNullSafe(F.col("new_person"))
            ).select("id"),
            "face belongs to another person",
        )
    touched = state.where(F.col("cluster_status") == "unreviewed").select("cluster_id")
    if check and touched.isEmpty():
        return ws
    open_faces = placed.where(F.col("cluster_status") == "unreviewed")
    images = [_face_rows(open_faces), cluster_images(ws, touched)]
    pending = reads.labelable(F.col("status")) & ~(
        (F.col("status") == "labeled") & F.col("person_id").eqNullSafe(F.col("new_person"))
    )
    changes = open_faces.where(pending).select("id", F.lit("labeled").alias("status"), F.col("new_person").alias("person_id"))
    after = _decided(open_faces, pending, F.lit("labeled"), F.col("new_person"), now)
    out = replace(ws, faces=_set_faces(ws.faces, changes, now), clusters=recompute_clusters(ws.clusters, after, touched, now))
    return _log(ws, out, "batch_label_clusters", mutation_id, command_payload(commands), images, now, check, after.where("_hit"))


def ignore_unreviewed(
    ws: Workspace, *, mutation_id: str, now: Column, check: bool = True
) -> tuple[Workspace, DataFrame]:
    """Ignore what is left. Unknown faces stay, and keep their cluster unknown.

    Returns the new workspace and a one-row report of what was done.
    """
    targets = ws.clusters.where(F.col("status") == "unreviewed").select(F.col("id").alias("cluster_id"))
    if check and (already_done(ws, mutation_id) is not None or targets.isEmpty()):
        return ws, _ignored_report(targets, _taken(ws, targets, False))[1]
    inside = _taken(ws, targets, check)
    outcome, report = _ignored_report(targets, inside)
    if check:
        _refuse(inside.where(F.col("status") == "labeled").select("id"), "unreviewed clusters contain labeled faces")
        if inside.isEmpty():
            raise ReviewConflict("unreviewed clusters contain no faces")
    images = [_face_rows(inside), cluster_images(ws, targets)]
    open_ = F.col("status") == "unreviewed"
    changes = inside.where(open_).select("id", F.lit("ignored").alias("status"), F.lit(None).cast("string").alias("person_id"))
    clusters = patch(
        ws.clusters, outcome, "id",
        {
            "status": F.col("_c.status"), "person_id": F.lit(None).cast("string"),
            "reviewed_at": now, "revision": F.col("revision") + 1, "updated_at": now,
        },
    )
    out = replace(ws, faces=_set_faces(ws.faces, changes, now), clusters=clusters)
    payload = report.select(F.to_json(F.struct(*report.columns)).alias("payload_json"))
    after = _decided(inside, open_, F.lit("ignored"), F.lit(None), now)
    return _log(ws, out, "ignore_all_unreviewed_clusters", mutation_id, payload, images, now, check, after.where("_hit")), report


def _ignored_report(targets: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster by cluster, in one row): what ignoring the rest does."""
    flags = inside.groupBy("cluster_id").agg(
        F.count_if(F.col("status") == "unknown").alias("unknown_faces"),
        F.count_if(F.col("status") == "unreviewed").alias("unreviewed_faces"),
        F.count_if(F.col("status") == "ignored").alias("ignored_faces"),
    )
    outcome = targets.join(flags, "cluster_id", "left").select(
        F.col("cluster_id").alias("id"),
        F.when(F.coalesce("unknown_faces", F.lit(0)) > 0, "unknown").otherwise("ignored").alias("status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unknown_faces", "unreviewed_faces", "ignored_faces")],
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    report = outcome.agg(
        F.count(F.lit(1)).alias("target_clusters"),
        F.count_if(F.col("status") == "ignored").alias("ignored_clusters"),
        F.count_if(F.col("status") == "unknown").alias("preserved_unknown_clusters"),
        total("unreviewed_faces").alias("ignored_faces"),
        total("unknown_faces").alias("preserved_unknown_faces"),
        total("ignored_faces").alias("preserved_ignored_faces"),
    )
    return outcome, report


def set_clusters(
    ws: Workspace, commands: DataFrame, state: str, *, mutation_id: str, now: Column, check: bool = True
) -> Workspace:
    """Mark clusters unreviewed, unknown or ignored.

    Marking unknown spares ignored faces; reopening an unknown cluster touches
    its unknown faces only.
    """
    if state not in ("unreviewed", "unknown", "ignored"):
        raise ValueError("Invalid disposition")
    if check:
        if already_done(ws, mutation_id) is not None:
            return ws
        _require_clusters(ws, commands)
    touched = commands.select("cluster_id").distinct()
    before = ws.clusters.select(F.col("id").alias("cluster_id"), F.col("status").alias("cluster_status"))
    placed = _taken(ws, touched.join(before, "cluster_id"), check)
    if state == "unknown":
        hit = F.col("status") != "ignored"
    elif state == "unreviewed":
        hit = (F.col("cluster_status") != "unknown") | (F.col("status") == "unknown")
    else:
        hit = F.lit(True)
    images = [_face_rows(placed), cluster_images(ws, touched)]
    changes = placed.where(hit).select(
        "id", F.lit(state).alias("status"), F.lit(None).cast("string").alias("person_id")
    )
    after = _decided(placed, hit, F.lit(state), F.lit(None), now)
    out = replace(ws, faces=_set_faces(ws.faces, changes, now), clusters=recompute_clusters(ws.clusters, after, touched, now))
    return _log(ws, out, f"{state}_cluster", mutation_id, command_payload(commands, state=state), images, now, check, after.where("_hit"))


def set_faces(
    ws: Workspace, commands: DataFrame, state: str, *, mutation_id: str, now: Column, check: bool = True
) -> Workspace:
    """Mark single faces and bring their clusters in line."""
    if state not in ("unreviewed", "unknown", "ignored"):
        raise ValueError("Invalid disposition")
    ids = commands.select(F.col("face_id").alias("id")).distinct()
    if check:
        if already_done(ws, mutation_id) is not None:
            return ws
    own = [c for c in schemas.MUTABLE_FACE_COLUMNS if c in ws.faces.columns]
    hit = ws.faces.select(*own, "quality_score").join(ids, "id", "left_semi")
    if check:
        hit = cut_lineage(hit, "taken", "zstd")
        _refuse(ids.join(hit, "id", "left_anti").select("id"), "face not found")
    touched = hit.where(F.col("cluster_id").isNotNull()).select("cluster_id").distinct()
    images = [
        _face_rows(hit), cluster_images(ws, touched),
    ]
    changes = hit.select("id", F.lit(state).alias("status"), F.lit(None).cast("string").alias("person_id"))
    faces = _set_faces(ws.faces, changes, now)
    out = replace(ws, faces=faces, clusters=recompute_clusters(ws.clusters, faces, touched, now))
    after = _decided(hit, F.lit(True), F.lit(state), F.lit(None), now)
    return _log(ws, out, f"{state}_face", mutation_id, command_payload(commands, state=state), images, now, check, after)


def remaining_faces(faces: DataFrame, commands: DataFrame) -> DataFrame:
    """Faces of the commanded clusters that were not selected."""
    clusters = commands.select("cluster_id").distinct()
    return faces.join(clusters, "cluster_id", "left_semi").join(
        commands.select(F.col("face_id").alias("id")), "id", "left_anti"
    )


def split_links(faces: DataFrame, commands: DataFrame) -> DataFrame:
    """Selected x remaining faces per cluster; selections are short lists."""
    rest = remaining_faces(faces, commands).select("cluster_id", F.col("id").alias("rest_id"))
    return commands.select("cluster_id", "face_id").distinct().join(rest, "cluster_id").select(
        F.least("face_id", "rest_id").alias("face_id_a"), F.greatest("face_id", "rest_id").alias("face_id_b")
    )


def split_clusters(
    ws: Workspace, commands: DataFrame, *, mutation_id: str, now: Column, check: bool = True, limit: int | None = None
) -> Workspace:
    """Move selected faces to a new cluster and keep both sides apart.

    ``limit`` refuses lists of more faces of one cluster; by default none.

    ``commands`` is (cluster_id, face_id). The new cluster's id is derived from
    the selected faces.
    """
    commands = commands.select("cluster_id", "face_id").distinct()
    if check:
        if already_done(ws, mutation_id) is not None:
            return ws
        _require_clusters(ws, commands)
        per = commands.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
        if limit is not None:
            _refuse(per.where(F.col("n") > limit).select("cluster_id"), f"no more than {limit} faces can be moved at once")
        member = ws.faces.select(F.col("id").alias("face_id"), "cluster_id")
        _refuse(
            commands.join(member, ["face_id", "cluster_id"], "left_anti").select("face_id"),
            "every selected face must belong to the cluster",
        )
        left_over = remaining_faces(ws.faces, commands).select("cluster_id")
        _refuse(
            per.join(left_over, "cluster_id", "left_anti").select("cluster_id"),
            "select at least one face, but not the entire cluster",
        )
    digest = member_digest(commands.withColumnRenamed("face_id", "id"), "cluster_id")
    new_ids = digest.select(
        "cluster_id", F.concat(F.lit("c_manual_"), F.substring("digest", 1, 32)).alias("new_id")
    )
    touched = new_ids.select("cluster_id")
    fresh = new_ids.select(F.col("new_id").alias("cluster_id"))
    dropped = _touching(ws.suggestions, touched)
    links = split_links(ws.faces, commands).select(
        "face_id_a", "face_id_b", F.lit("manual_split").alias("reason"), now.cast("string").alias("created_at")
    )
    # Two faces of one photo are kept apart as they are.
    photo = ws.faces.select("id", "photo_id")
    links = reads._pairs_of(links, photo, "photo_id").where("photo_id_a <> photo_id_b").drop("photo_id_a", "photo_id_b")
    added = links.join(ws.cannot_links.select("face_id_a", "face_id_b"), ["face_id_a", "face_id_b"], "left_anti")
    images = [
        face_images(ws, touched), cluster_images(ws, touched), suggestion_images(dropped),
        _image(fresh, "clusters", "cluster_id", (), "delete"),
        _image(added.withColumn("_key", F.concat_ws("|", "face_id_a", "face_id_b")), "cannot_links", "_key", (), "delete"),
    ]
    changes = commands.join(new_ids, "cluster_id").select(
        F.col("face_id").alias("id"), "new_id", F.lit("unreviewed").alias("status"),
        F.lit(None).cast("string").alias("person_id"),
    )
    faces = _set_faces(ws.faces, changes, now, cluster_id=F.col("_c.new_id"))
    text = now.cast("string")
    created = fresh.select(
        F.col("cluster_id").alias("id"), F.lit("manual").alias("origin"), F.lit("unreviewed").alias("status"),
        F.lit(0).alias("revision"), text.alias("created_at"), text.alias("updated_at"),
    )
    clusters = ws.clusters.unionByName(created, allowMissingColumns=True)
    out = replace(
        ws, faces=faces,
        clusters=recompute_clusters(clusters, faces, touched.unionByName(fresh), now),
        suggestions=delete_keys(ws.suggestions, dropped, ["cluster_id_a", "cluster_id_b"]),
        cannot_links=insert_missing(ws.cannot_links, links, ["face_id_a", "face_id_b"]),
    )
    return _log(ws, out, "split_cluster", mutation_id, command_payload(commands), images, now, check)


def merge_targets(commands: DataFrame) -> DataFrame:
    """(cluster_id, target): the smallest id of each merge group."""
    target = commands.groupBy("merge_group").agg(F.min("cluster_id").alias("target"))
    return commands.select("merge_group", "cluster_id").distinct().join(target, "merge_group")


def merge_clusters(
    ws: Workspace, commands: DataFrame, *, mutation_id: str, now: Column, check: bool = True
) -> Workspace:
    """Merge clusters by ``merge_group`` into the group's smallest id.

    A group may not name two people nor join faces that must stay apart.
    """
    mapping = merge_targets(commands)
    if check:
        if already_done(ws, mutation_id) is not None:
            return ws
        _require_clusters(ws, commands)
        _refuse(
            mapping.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("cluster_id"),
            "a cluster may be in one merge group only",
        )
        _refuse(
            mapping.groupBy("merge_group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < 2).select("merge_group"),
            "select at least two clusters",
        )
        owners = mapping.join(ws.clusters.select(F.col("id").alias("cluster_id"), "person_id"), "cluster_id")
        people = owners.groupBy("merge_group").agg(F.min("person_id").alias("lo"), F.max("person_id").alias("hi"))
        _refuse(people.where(F.col("lo") != F.col("hi")).select("merge_group"), "clusters belong to different people")
        group = mapping.select("cluster_id", "target")
        linked = reads.linked_groups(group.withColumnRenamed("target", "group"), ws.faces, ws.cannot_links)
        _refuse(linked.select("group"), "some faces of the group were kept apart")
    every = mapping.select("cluster_id")
    moved = mapping.where(F.col("cluster_id") != F.col("target")).select("cluster_id", "target")
    targets = mapping.select(F.col("target").alias("cluster_id")).distinct()
    dropped = _touching(ws.suggestions, every)
    images = [face_images(ws, every), cluster_images(ws, every), suggestion_images(dropped)]
    faces = patch(
        ws.faces, ws.faces.select("id", "cluster_id").join(moved, "cluster_id").select("id", "target"), "id",
        {"cluster_id": F.col("_c.target"), "revision": F.col("revision") + 1, "updated_at": now},
    )
    clusters = delete_keys(ws.clusters, moved.select(F.col("cluster_id").alias("id")), ["id"])
    clusters = patch(
        clusters, targets.select(F.col("cluster_id").alias("id")), "id",
        {"origin": F.lit("manual"), "revision": F.col("revision") + 1, "updated_at": now},
    )
    out = replace(
        ws, faces=faces, clusters=recompute_clusters(clusters, faces, targets, now),
        suggestions=delete_keys(ws.suggestions, dropped, ["cluster_id_a", "cluster_id_b"]),
    )
    return _log(ws, out, "merge_clusters", mutation_id, command_payload(commands), images, now, check)


def undo_last(ws: Workspace, now: Column, *, write: bool = True) -> tuple[Workspace, str | None]:
    """Undo the newest action that is not undone yet; its type, or None."""
    latest = ws.actions.where(F.col("undone_at").isNull()).agg(
        F.max("id").alias("id"), F.max_by("action_type", "id").alias("action_type")
    ).head()
    if latest["id"] is None:
        return ws, None
    images = ws.images.where(F.col("action_id") == latest["id"])
    if write and "images" not in ws.layers:
        # Five tables are restored from these rows: read them out once. Layers are read where they lie.
        images = cut_lineage(images, "images")

    def restored(table: str, frame: DataFrame, columns) -> DataFrame:
        shape = T.StructType([frame.schema[c] for c in columns])
        rows = images.where((F.col("table_name") == table) & (F.col("undo") == "restore"))
        return rows.select(F.from_json("row_json", shape).alias("r")).select("r.*")

    def created(table: str) -> DataFrame:
        return images.where((F.col("table_name") == table) & (F.col("undo") == "delete")).select("key")

    face_columns = [c for c in schemas.MUTABLE_FACE_COLUMNS if c in ws.faces.columns]
    before = restored("faces", ws.faces, face_columns)
    faces = patch(
        ws.faces, before, "id",
        {c: F.col(f"_c.{c}") for c in face_columns if c != "id"},
    )
    clusters = upsert(ws.clusters, restored("clusters", ws.clusters, schemas.MUTABLE_CLUSTER_COLUMNS), ["id"])
    clusters = delete_keys(clusters, created("clusters").withColumnRenamed("key", "id"), ["id"])
    people = delete_keys(ws.people, created("people").withColumnRenamed("key", "id"), ["id"])
    suggestions = upsert(
        ws.suggestions, restored("suggestions", ws.suggestions, ws.suggestions.columns),
        ["cluster_id_a", "cluster_id_b"],
    )
    pair = F.split("key", r"\|")
    links = delete_keys(
        ws.cannot_links,
        created("cannot_links").select(pair[0].alias("face_id_a"), pair[1].alias("face_id_b")),
        ["face_id_a", "face_id_b"],
    )
    stamp = F.when(F.col("id") == latest["id"], now.cast("string")).otherwise(F.col("undone_at"))
    undone = replace(
        ws, faces=faces, clusters=clusters, people=people, suggestions=suggestions,
        cannot_links=links, actions=ws.actions.withColumn("undone_at", stamp),
    )
    if write:
        stamped = ws.actions.where(F.col("id") == latest["id"]).select("id")
        undone = settled(ws, undone, images, stamped, faces=before)
    return undone, latest["action_type"]
