"""Catalog listings, facets, paging and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cursor import Cursor
from ..functions.text import iso_micros
from ..operators import facets, paging
from ..operators.numbering import dense_index
from ..plans import gallery, publish
from .registry import query
from .roles import ALBUM, PREFIX, SEED

ISO = "strftime(captured_at,'%Y-%m-%dT%H:%M:%S.%fZ')"
LAST_ID = "p_8"
def _now():
    return F.to_timestamp(F.lit("2030-01-01 00:00:00"))
PERSON_3 = "'person-'||substr(sha256('s3'),1,12)"


def _slug3(r):
    import hashlib

    return "person-" + hashlib.sha256(b"s3").hexdigest()[:12]


@query("f1_published_album", f"SELECT id, album_position FROM pictures WHERE album_id='{ALBUM}' AND published", ("pictures",))
def _(r):
    return paging.published_in_album(r.pictures, ALBUM).select("id", "album_position")


@query("s6_catalog_scan", """SELECT album_id, count(*) AS pictures, min(album_position) AS lo, max(album_position) AS hi
  FROM pictures WHERE published GROUP BY 1""", ("pictures",))
def _(r):
    shown = r.pictures.where(F.col("published"))
    return shown.groupBy("album_id").agg(
        F.count(F.lit(1)).alias("pictures"), F.min("album_position").alias("lo"), F.max("album_position").alias("hi")
    )


@query("f2_gallery_projection", f"""SELECT id, original_filename, album_position, width, height, thumb_key, display_key,
  blur_data_url, {ISO} AS captured_at_cursor FROM keyed_pictures WHERE album_id='{ALBUM}' AND published""", ("keyed_pictures",))
def _(r):
    return paging.gallery_projection(paging.published_in_album(r.keyed_pictures, ALBUM)).drop("captured_at")


def _after(r, cursor):
    return paging.published_in_album(r.pictures, ALBUM).where(paging.after_cursor(cursor)).select("id", "album_position")


BASE = f"SELECT id, album_position FROM pictures WHERE album_id='{ALBUM}' AND published AND "


@query("f3_keyset_position", BASE + f"(album_position, id) > (70, '{LAST_ID}')", ("pictures",))
def _(r):
    return _after(r, Cursor("album", LAST_ID, position=70))


@query("f4_keyset_newest", BASE + f"""(captured_at IS NULL OR captured_at < TIMESTAMP '1997-05-28'
  OR (captured_at = TIMESTAMP '1997-05-28' AND (album_position, id) > (70, '{LAST_ID}')))""", ("pictures",))
def _(r):
    return _after(r, Cursor("newest", LAST_ID, position=70, captured_at="1997-05-28T00:00:00.000000Z"))


@query("f4_keyset_oldest", BASE + f"""(captured_at IS NULL OR captured_at > TIMESTAMP '1997-05-28'
  OR (captured_at = TIMESTAMP '1997-05-28' AND (album_position, id) > (70, '{LAST_ID}')))""", ("pictures",))
def _(r):
    return _after(r, Cursor("oldest", LAST_ID, position=70, captured_at="1997-05-28T00:00:00.000000Z"))


@query("f5_keyset_null_tail", BASE + f"captured_at IS NULL AND (album_position, id) > (70, '{LAST_ID}')", ("pictures",))
def _(r):
    return _after(r, Cursor("newest", LAST_ID, position=70))


@query("f6_keyset_shuffle", BASE + f"(md5('{SEED}:'||id), id) > ('7f', '{LAST_ID}')", ("pictures",))
def _(r):
    return _after(r, Cursor("shuffle", LAST_ID, seed=SEED, shuffle_key="7f"))


ORDERS = {
    "album": "album_position, id",
    "newest": "captured_at DESC NULLS LAST, album_position, id",
    "oldest": "captured_at ASC NULLS LAST, album_position, id",
    "shuffle": f"md5('{SEED}:'||id), id",
}


def _page(sort):
    def run(r):
        shown = paging.published_in_album(r.pictures, ALBUM)
        page = paging.page(shown, sort, 121, seed=SEED)
        return page.select("id", "album_position", iso_micros(F.col("captured_at")).alias("captured_at_cursor"))

    return run


for _name, _sort in (("o1_page_album", "album"), ("o2_page_newest", "newest"), ("o3_page_oldest", "oldest"), ("o4_page_shuffle", "shuffle")):
    query(_name, f"SELECT id, album_position, {ISO} AS captured_at_cursor FROM pictures WHERE album_id='{ALBUM}' AND published ORDER BY {ORDERS[_sort]} LIMIT 121", ("pictures",))(_page(_sort))


@query("o5_limit_plus_one", f"""SELECT count(*) > 60 AS has_more, least(count(*),60) AS visible,
  max(CASE WHEN rn=60 THEN id END) AS last_visible_id FROM (SELECT id, row_number() OVER (ORDER BY album_position, id) AS rn
  FROM pictures WHERE album_id='{ALBUM}' AND published) WHERE rn<=61""", ("pictures",))
def _(r):
    rows = paging.page(paging.published_in_album(r.pictures, ALBUM), "album", 61).select("id", "album_position")
    ranked = rows.select("id", F.struct("album_position", "id").alias("k"))
    # At most 61 rows: the last visible one is the 60th smallest key.
    keyed = F.sort_array(F.collect_list("k"))
    return ranked.agg(
        (F.count(F.lit(1)) > 60).alias("has_more"), F.least(F.count(F.lit(1)), F.lit(60)).cast("bigint").alias("visible"),
        F.get(keyed, F.lit(59))["id"].alias("last_visible_id"),
    )


def _boundary_sql(sort):
    fields = {
        "album": "'p', album_position, 'i', id",
        "newest": f"'t', {ISO}, 'p', album_position, 'i', id",
        "oldest": f"'t', {ISO}, 'p', album_position, 'i', id",
        "shuffle": f"'r', '{SEED}', 'k', md5('{SEED}:'||id), 'i', id",
    }[sort]
    return f"""SELECT page_no, rows, last_id, CASE WHEN page_no*60+rows<total THEN
  translate(rtrim(base64(encode(body)),'='),'+/','-_') END AS next_cursor FROM (
  SELECT i//60 AS page_no, count(*) OVER (PARTITION BY i//60) AS rows, id AS last_id, total, i,
  max(i) OVER (PARTITION BY i//60) AS mi, json_object('v',2,'s','{sort}','f',NULL,{fields})::VARCHAR AS body FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDERS[sort]})-1 AS i, count(*) OVER () AS total FROM pictures
  WHERE album_id='{ALBUM}' AND published)) WHERE i=mi"""


def _boundaries(sort):
    return lambda r: paging.page_boundaries(
        paging.published_in_album(r.pictures, ALBUM), sort, 60, seed=SEED if sort == "shuffle" else None
    )


for _sort in ORDERS:
    query(f"o7_boundaries_{_sort}", _boundary_sql(_sort), ("pictures",))(_boundaries(_sort))


@query("o6_full_walk_newest", f"""SELECT id, row_number() OVER (ORDER BY {ORDERS['newest']})-1 AS global_index
  FROM pictures WHERE album_id='{ALBUM}' AND published""", ("pictures",))
def _(r):
    shown = paging.published_in_album(r.pictures, ALBUM).select("id", "album_position", "captured_at")
    return dense_index(shown, paging.sort_columns("newest"), "global_index").select("id", "global_index")


@query("w5_dense_positions", """SELECT id, row_number() OVER (ORDER BY captured_at ASC NULLS LAST, album_position, id)-1 AS position
  FROM pictures""", ("pictures",))
def _(r):
    keys = r.pictures.select("id", "album_position", "captured_at")
    return dense_index(keys, paging.sort_columns("oldest"), "position").select("id", "position")


@query("j1_person_facet", f"""SELECT id FROM pictures ph WHERE published AND EXISTS (SELECT 1 FROM links l JOIN people pe
  ON pe.id=l.person_id WHERE l.photo_id=ph.id AND pe.album_id=ph.album_id AND pe.slug={PERSON_3})""", ("pictures", "people", "links"))
def _(r):
    shown = r.pictures.where(F.col("published"))
    return facets.with_person(shown, r.links, r.people, _slug3(r)).select("id")


@query("j2_people_links_pictures", """SELECT l.photo_id, l.person_id FROM people pe JOIN links l ON l.person_id=pe.id
  JOIN pictures ph ON ph.id=l.photo_id AND ph.album_id=pe.album_id AND ph.published""", ("pictures", "people", "links"))
def _(r):
    return facets.people_in_published_pictures(r.people, r.links, r.pictures).select("photo_id", "person_id")


@query("a1_facet_total", f"""SELECT count(*) AS photo_count FROM pictures ph WHERE published AND EXISTS (SELECT 1 FROM links l
  JOIN people pe ON pe.id=l.person_id WHERE l.photo_id=ph.id AND pe.album_id=ph.album_id AND pe.slug={PERSON_3})""",
  ("pictures", "people", "links"))
def _(r):
    shown = r.pictures.where(F.col("published"))
    return facets.facet_total(facets.with_person(shown, r.links, r.people, _slug3(r)))


def _albums(r):
    """Albums with their stored totals, as the refresh maintains them."""
    return publish.album_rollup(r.pictures).select(
        F.col("album_id").alias("id"), F.lower("album_id").alias("slug"), "photo_count", "captured_at_min", "captured_at_max",
        F.lit("captured_at_asc").alias("default_sort"), F.lit(None).cast("timestamp").alias("updated_at"),
    )


@query("a2_stored_total", f"SELECT count(*) AS photo_count FROM pictures WHERE album_id='{ALBUM}' AND published", ("pictures",))
def _(r):
    return facets.stored_total(_albums(r), ALBUM)


PEOPLE_COUNTS = """SELECT pe.id, pe.slug, pe.display_name, count(l.photo_id) AS photo_count FROM people pe
  JOIN links l ON l.person_id=pe.id JOIN pictures ph ON ph.id=l.photo_id AND ph.album_id=pe.album_id AND ph.published
  GROUP BY 1,2,3"""


@query("a3_people_counts", PEOPLE_COUNTS, ("pictures", "people", "links"))
def _(r):
    return facets.people_counts(r.people, r.links, r.pictures)


@query("o8_people_listing", PEOPLE_COUNTS + " ORDER BY lower(pe.display_name), pe.display_name, pe.id", ("pictures", "people", "links"))
def _(r):
    return facets.listing_order(facets.people_counts(r.people, r.links, r.pictures))


@query("a4_album_rollup", """SELECT album_id, count(*) AS photo_count, strftime(min(captured_at),'%Y-%m-%d') AS lo,
  strftime(max(captured_at),'%Y-%m-%d') AS hi FROM pictures WHERE published GROUP BY 1""", ("pictures",))
def _(r):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return publish.album_rollup(r.pictures).select(
        "album_id", "photo_count", day("captured_at_min").alias("lo"), day("captured_at_max").alias("hi")
    )


@query("f14_facet_exists", f"""SELECT coalesce(bool_or(slug={PERSON_3}),false) AS facet_exists FROM ({PEOPLE_COUNTS})""",
  ("pictures", "people", "links"))
def _(r):
    return facets.facet_exists(facets.people_counts(r.people, r.links, r.pictures), _slug3(r))


@query("o9_featured_first", """SELECT id, display_name, row_number() OVER (ORDER BY pin, display_name, id)-1 AS place FROM (
  SELECT * FROM (SELECT id, part_name AS display_name, pin, row_number() OVER (PARTITION BY pin ORDER BY part_name DESC, id DESC) AS n
  FROM named WHERE pin IS NOT NULL) WHERE n=1 UNION ALL SELECT id, part_name, 1048576, 1 FROM named WHERE pin IS NULL)""".join(
    ["""WITH named AS (SELECT 'person_'||substr(sha256('s'||p_partkey),1,32) AS id, p_name AS part_name,
  CASE lower(trim(p_name)) WHEN 'red widget' THEN 1 WHEN 'small ring' THEN 2 END AS pin FROM part)\n""", ""]))
def _(r):
    from .roles import person_id

    named = r.table("part").select(person_id(F.col("p_partkey")).alias("id"), F.col("p_name").alias("display_name"))
    ordered = facets.featured_first(named, ["red widget", "small ring"], order=["display_name", "id"])
    pins = F.array_position(F.array(F.lit("red widget"), F.lit("small ring")), F.lower(F.trim("display_name")))
    rank = F.when(pins > 0, pins).otherwise(1 << 20)
    return dense_index(ordered.withColumn("_r", rank), [F.col("_r"), F.col("display_name"), F.col("id")], "place").select(
        "id", "display_name", "place"
    )


@query("f8_accent_search", "SELECT doc_id FROM documents WHERE strip_accents(lower(text)) LIKE '%ereau%'")
def _(r):
    docs = r.table("documents").select("doc_id", F.col("text").alias("display_name"))
    return facets.search_people(docs, " éREau ").select("doc_id")


@query("w9_joined_pages", """SELECT id, row_number() OVER (ORDER BY page, position)-1 AS global_index FROM (
  SELECT user_id AS id, page, position, row_number() OVER (PARTITION BY user_id ORDER BY page, position) AS n FROM (
  SELECT user_id, event_id//60 AS page, event_id AS position FROM events)) WHERE n=1""")
def _(r):
    pages = r.table("events").select(
        F.col("user_id").alias("id"), F.floor(F.col("event_id") / 60).alias("page"), F.col("event_id").alias("position")
    )
    return gallery.joined_pages(pages, "page", "position").select("id", "global_index")


@query("a16_earliest_expiry", "SELECT min(CASE WHEN x>0 THEN x END) AS earliest_expiry FROM (SELECT event_id-500 AS x FROM events)")
def _(r):
    pages = r.table("events").select((F.col("event_id") - 500).alias("media_expires_at"))
    return gallery.earliest_expiry(pages)


# Publishing ----------------------------------------------------------------------

def _manifest(r):
    """The run's pictures: two of three runs' rows, with new file names."""
    return r.pictures.select(
        "id", "album_id", F.concat(F.lit("NEW_"), "original_filename").alias("original_filename"), "album_position", "published", "captured_at"
    )


STAGED = """staged AS (SELECT id, album_id, CASE WHEN m THEN 'NEW_'||original_filename ELSE original_filename END AS original_filename,
  CASE WHEN m THEN 'run_9' ELSE imported_run_id END AS imported_run_id, CASE WHEN e THEN published ELSE false END AS published FROM (
  SELECT *, o_orderstatus<>'O' AS e, o_orderstatus<>'P' AS m FROM pictures) WHERE e OR m)"""


def _stage(r):
    """Stored: all but open orders. Incoming manifest: all but pending ones."""
    stored = r.pictures.where(F.col("o_orderstatus") != "O").select(
        "id", "album_id", "original_filename", "album_position", "published", "imported_run_id", "captured_at"
    )
    incoming = _manifest(r).join(r.pictures.where(F.col("o_orderstatus") != "P").select("id"), "id", "left_semi")
    return publish.stage_pictures(stored, incoming, "run_9", _now())


def _with_staged(sql):
    from .roles import CTES

    return f"WITH pictures AS ({CTES['pictures']}),\n{STAGED}\n{sql}"


@query("m2_stage_pictures", _with_staged("SELECT id, original_filename, imported_run_id, published FROM staged"))
def _(r):
    return _stage(r).select("id", "original_filename", "imported_run_id", "published")


@query("m3_publish_guard", _with_staged("""SELECT album_id, count(*) AS staged FROM staged WHERE imported_run_id='run_9' GROUP BY 1"""))
def _(r):
    return _stage(r).where(F.col("imported_run_id") == "run_9").groupBy("album_id").agg(F.count(F.lit(1)).alias("staged"))


@query("m3_publish_run", _with_staged(f"""SELECT id, CASE WHEN album_id='{ALBUM}' AND imported_run_id='run_9' THEN true
  ELSE published END AS published FROM staged"""))
def _(r):
    return publish.visibility_after(_stage(r), ALBUM, "run_9", False, _now()).select("id", "published")


@query("m4_authoritative_sync", _with_staged(f"""SELECT id, CASE WHEN album_id<>'{ALBUM}' THEN published
  ELSE imported_run_id IS NOT DISTINCT FROM 'run_9' END AS published FROM staged"""))
def _(r):
    return publish.visibility_after(_stage(r), ALBUM, "run_9", True, _now()).select("id", "published")


@query("m1_album_run_upsert", """SELECT id, coalesce(b.slug, a.slug) AS slug, CASE WHEN a.id IS NULL THEN 0 ELSE a.photo_count END AS photo_count,
  CASE WHEN b.id IS NULL THEN 'completed' ELSE 'running' END AS status FROM
  (SELECT o_orderpriority AS id, lower(o_orderpriority) AS slug, count(*) AS photo_count FROM orders WHERE o_orderstatus<>'P' GROUP BY 1,2) a
  FULL JOIN (SELECT n_name AS id, 'new-'||n_name AS slug FROM nation UNION ALL SELECT '2-HIGH','new-2-HIGH') b USING (id)""")
def _(r):
    names = r.table("nation").select(F.col("n_name").alias("id"))
    # One existing album is refreshed along with the new ones.
    known = r.pictures.where(F.col("album_id") == "2-HIGH").select(F.col("album_id").alias("id")).distinct()
    incoming = names.unionByName(known).select("id", F.concat(F.lit("new-"), "id").alias("slug"))
    albums = publish.upsert_albums(_albums(r), incoming.withColumn("default_sort", F.lit("captured_at_desc")), _now())
    runs = _albums(r).select(
        "id", F.col("id").alias("album_id"), F.lit("completed").alias("status"), F.lit(1).alias("imported_count"),
        F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    started = publish.upsert_runs(runs, incoming.select("id", F.col("id").alias("album_id")), _now())
    return albums.join(started.select("id", "status"), "id").select("id", "slug", "photo_count", "status")


@query("m5_refresh_albums", _with_staged("""SELECT a.id, coalesce(n,0) AS photo_count, CASE WHEN a.id='2-HIGH' THEN 'completed' ELSE 'running' END AS status
  FROM (SELECT DISTINCT album_id AS id FROM pictures) a LEFT JOIN (SELECT album_id, count(*) AS n FROM staged WHERE published GROUP BY 1) s ON s.album_id=a.id"""))
def _(r):
    albums = _albums(r)
    fresh = publish.refresh_albums(albums, _stage(r), _now())
    runs = albums.select("id", F.lit("running").alias("status"), F.lit(0).alias("imported_count"))
    closed = publish.close_run(runs, "2-HIGH", status="completed", imported=1, failed=0, completed_at=_now(), now=_now())
    return fresh.join(closed.select("id", "status"), "id").select("id", "photo_count", "status")


@query("m6_people_upsert", """SELECT coalesce(a.id,b.id) AS id, coalesce(a.album_id,b.album_id) AS album_id,
  coalesce(b.display_name,a.display_name) AS display_name FROM (SELECT * FROM people WHERE s_acctbal<6000) a
  FULL JOIN (SELECT id, 'other' AS album_id, 'New '||display_name AS display_name FROM people WHERE s_acctbal>=3000) b ON a.id=b.id""", ("people",))
def _(r):
    columns = ("id", "album_id", "display_name")
    stored = r.people.where(F.col("s_acctbal") < 6000).select(*columns)
    incoming = r.people.where(F.col("s_acctbal") >= 3000).select(
        "id", F.lit("other").alias("album_id"), F.concat(F.lit("New "), "display_name").alias("display_name")
    )
    return publish.upsert_people(stored, incoming)


def _incoming_links(r):
    """Incoming associations: the shipped-flag half of the fact table."""
    from .roles import person_id, photo_id

    li = r.table("lineitem").where(F.col("l_returnflag") != "N")
    return li.select(photo_id(F.col("l_orderkey")).alias("photo_id"), person_id(F.col("l_suppkey")).alias("person_id")).distinct()


INCOMING = """incoming AS (SELECT DISTINCT 'p_'||substr(sha256(l_orderkey::VARCHAR),1,32) AS photo_id,
  'person_'||substr(sha256('s'||l_suppkey),1,32) AS person_id FROM lineitem WHERE l_returnflag<>'N')"""


def _with_incoming(sql):
    from .roles import CTES

    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in ("pictures", "people", "links"))
    return f"WITH {ctes},\n{INCOMING}\n{sql}"


@query("j6_links_outside_album", _with_incoming(f"""SELECT i.photo_id, i.person_id FROM incoming i LEFT JOIN pictures ph ON ph.id=i.photo_id
  WHERE ph.id IS NULL OR ph.album_id<>'{ALBUM}'"""))
def _(r):
    return publish.strangers(_incoming_links(r), r.pictures, ALBUM)


@query("j7_stale_links", _with_incoming(f"""SELECT l.photo_id, l.person_id FROM links l JOIN pictures ph ON ph.id=l.photo_id AND ph.album_id='{ALBUM}'
  WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.photo_id=l.photo_id AND i.person_id=l.person_id)"""))
def _(r):
    return publish.stale_links(r.links, r.pictures, _incoming_links(r), ALBUM)


@query("j8_stale_people", _with_incoming(f"""SELECT id FROM people pe WHERE album_id='{ALBUM}' AND NOT EXISTS (
  SELECT 1 FROM people x WHERE x.id=pe.id AND x.s_acctbal>=3000)"""))
def _(r):
    incoming = r.people.where(F.col("s_acctbal") >= 3000)
    return publish.stale_people(r.people, incoming, ALBUM).select("id")


@query("m7_replace_associations", _with_incoming(f"""SELECT photo_id, person_id FROM (
  SELECT l.photo_id, l.person_id FROM links l LEFT JOIN pictures ph ON ph.id=l.photo_id WHERE ph.album_id IS DISTINCT FROM '{ALBUM}'
  UNION SELECT i.photo_id, i.person_id FROM incoming i JOIN pictures ph ON ph.id=i.photo_id AND ph.album_id='{ALBUM}') u
  WHERE NOT EXISTS (SELECT 1 FROM people pe WHERE pe.id=u.person_id AND pe.album_id='{ALBUM}' AND pe.s_acctbal<3000)"""))
def _(r):
    """Set part of the replacement; the guards are exercised in the tests."""
    from ..operators.tables import delete_keys, insert_missing

    from ..functions.packing import packed, unpacked

    # All steps compare ids only, so these go through the shuffles as bytes.
    short = lambda df, *ids: df.withColumns({c: packed(F.col(c)) for c in ids})
    key = ["photo_id", "person_id"]
    pictures, people, stored = short(r.pictures.select("id", "album_id"), "id"), short(r.people, "id"), short(r.links, *key)
    ours = pictures.where(F.col("album_id") == ALBUM).select(F.col("id").alias("photo_id"))
    incoming = short(_incoming_links(r), *key).join(ours.hint("merge"), "photo_id", "left_semi")
    links = delete_keys(stored, publish.stale_links(stored, pictures, incoming, ALBUM), key)
    links = insert_missing(links, incoming, key)
    leaving = publish.stale_people(people, people.where(F.col("s_acctbal") >= 3000), ALBUM)
    return delete_keys(links, leaving.select(F.col("id").alias("person_id")), ["person_id"]).select(*[unpacked(F.col(c)).alias(c) for c in key])


@query("d2_people_avatar_rules", f"""SELECT id FROM (SELECT *, sha256('a'||s_suppkey) AS sha FROM people) WHERE s_suppkey%3<>0""", ("people",))
def _(r):
    """A third of the avatars is complete; the others lack a part or disagree."""
    from ..functions.hashing import avatar_key
    from ..operators.rules import violations
    from ..plans.checks import avatar_rule

    k = F.col("s_suppkey")
    sha = F.sha2(F.concat(F.lit("a"), k.cast("string")).cast("binary"), 256)
    table = r.people.select(
        "id", avatar_key(PREFIX, F.col("id"), sha).alias("avatar_key"),
        F.when(k % 3 == 1, F.reverse(sha)).otherwise(sha).alias("avatar_sha256"),
        F.lit(320).alias("avatar_width"), F.when(k % 3 != 2, 320).alias("avatar_height"),
    )
    return violations(table, F.col("id"), {"avatar": avatar_rule(PREFIX)}).select(F.col("key").alias("id"))


def flagship(r):
    """First and second page of an album through the cursor of the first."""
    shown = paging.published_in_album(r.keyed_pictures, ALBUM)
    first = paging.page(shown, "newest", 61).collect()
    last = first[59] if len(first) > 60 else first[-1]
    taken = last["captured_at"]
    cursor = Cursor(
        "newest", last["id"], position=last["album_position"],
        captured_at=None if taken is None else taken.strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
    )
    return paging.gallery_projection(paging.page(shown, "newest", 60, cursor=cursor))
