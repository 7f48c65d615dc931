"""Hashes, names, keys, signing and coercions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, geometry, hashing, keys, signing, text, vectors
from ..functions.cursor import cursor_column
from ..operators.paging import shuffle_key
from ..plans import ingest
from .registry import query, tree_sql
from .roles import PREFIX, SEED

SECRET = b"an-example-secret-of-32-bytes-ok"
NOW_S = 1_900_000_000


@query("x1_hash_identities", f"""SELECT doc_id, md5('{SEED}:'||doc_id) AS shuffle_key, 'p_'||substr(sha256(text),1,32) AS photo_id,
  '{PREFIX}/'||substr(sha256(text),1,2)||'/p_'||substr(sha256(text),1,32)||'/thumb-'||substr(sha256(lang),1,20)||'.webp' AS object_key
  FROM documents""")
def _(r):
    sha = hashing.sha256_hex(F.col("text"))
    return r.table("documents").select(
        "doc_id", shuffle_key(SEED, F.col("doc_id").cast("string")).alias("shuffle_key"),
        hashing.photo_id(sha).alias("photo_id"),
        hashing.object_key(PREFIX, sha, "thumb", hashing.sha256_hex(F.col("lang")), F.lit("webp")).alias("object_key"),
    )


@query("x2_nul_fingerprint", """SELECT doc_id, sha256(source||chr(0)||n_chars||chr(0)||(doc_id*1000)||chr(0)||'profile') AS signature,
  sha256(sha256(text)||chr(0)||'image/webp'||chr(0)||'public') AS upload_fingerprint FROM documents""")
def _(r):
    return r.table("documents").select(
        "doc_id",
        hashing.source_signature(F.col("source"), F.col("n_chars"), F.col("doc_id") * 1000, F.lit("profile")).alias("signature"),
        hashing.upload_fingerprint(hashing.sha256_hex(F.col("text")), F.lit("image/webp"), F.lit("public")).alias("upload_fingerprint"),
    )


@query("x3_canonical_json", """SELECT event_id, json_object('event_id',event_id,'event_type',event_type,'user_id',user_id)::VARCHAR AS body,
  sha256(json_object('event_id',event_id,'event_type',event_type,'user_id',user_id)::VARCHAR) AS digest FROM events""")
def _(r):
    parts = {c: F.col(c) for c in ("user_id", "event_type", "event_id")}
    return r.table("events").select(
        "event_id", hashing.canonical_json(**parts).alias("body"), hashing.canonical_sha256(**parts).alias("digest")
    )


@query("x4_iso_timestamps", """SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S.%fZ') AS micros,
  strftime(ts,'%Y-%m-%dT%H:%M:%S.%gZ') AS millis, true AS valid FROM events""")
def _(r):
    ts = F.col("ts").cast("timestamp")
    micros = text.iso_micros(ts)
    return r.table("events").select(
        "event_id", micros.alias("micros"), text.iso_millis(ts).alias("millis"), text.valid_iso(micros).alias("valid")
    )


@query("x5_name_normalization", """SELECT p_partkey, CASE WHEN lower(word)='red' THEN 'Scarlet' ELSE word END AS display_name,
  lower(CASE WHEN lower(word)='red' THEN 'Scarlet' ELSE word END) AS name_key FROM (
  SELECT p_partkey, string_split(trim(regexp_replace('  '||p_name||' ','\\s+',' ','g')),' ')[1] AS word FROM part)""")
def _(r):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" "))
    name = text.first_name(raw, aliases={"red": "Scarlet"})
    return r.table("part").select("p_partkey", name.alias("display_name"), text.name_key(name).alias("name_key"))


@query("x6_natural_key", """SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(url),'[0-9]+|[^0-9]+'),
  lambda t: CASE WHEN t[1] BETWEEN '0' AND '9' THEN printf('%05d', length(ltrim(t,'0')))||ltrim(t,'0') ELSE t END), '') AS natural_key FROM pages""")
def _(r):
    return r.table("pages").select("page_id", text.natural_key(F.col("url")).alias("natural_key"))


@query("x7_accent_fold", "SELECT doc_id, regexp_replace(lower(strip_accents(text)),'^\\s+|\\s+$','','g') AS folded FROM documents")
def _(r):
    return r.table("documents").select("doc_id", text.accent_fold(F.col("text")).alias("folded"))


KEYED = f"""SELECT id, k, regexp_extract(k,'^{PREFIX}/([a-f0-9]{{2}})/p_([a-f0-9]{{32}})/(thumb|display)-([a-f0-9]{{20}})[.](webp|avif|jpeg)$',1) AS shard,
  regexp_extract(k,'^{PREFIX}/([a-f0-9]{{2}})/p_([a-f0-9]{{32}})/(thumb|display)-([a-f0-9]{{20}})[.](webp|avif|jpeg)$',3) AS kind,
  regexp_extract(k,'^{PREFIX}/([a-f0-9]{{2}})/p_([a-f0-9]{{32}})/(thumb|display)-([a-f0-9]{{20}})[.](webp|avif|jpeg)$',5) AS ext"""


@query("x8_key_parts", KEYED + " FROM (SELECT id, thumb_key AS k FROM keyed_pictures UNION ALL SELECT id, display_key FROM keyed_pictures)", ("keyed_pictures",))
def _(r):
    both = r.keyed_pictures.select("id", F.explode(F.array("thumb_key", "display_key")).alias("k"))
    part = keys.parse_photo_key(F.col("k"), PREFIX)
    return both.select("id", "k", part["shard"].alias("shard"), part["kind"].alias("kind"), part["ext"].alias("ext"))


@query("x9_path_safety", """SELECT page_id, list_contains(string_split(url,'/'),'') OR list_contains(string_split(url,'/'),'.')
  OR list_contains(string_split(url,'/'),'..') OR starts_with(url,'/') OR contains(url,chr(92)) AS unsafe_url,
  path LIKE '%/en/%' AS below FROM (SELECT page_id, url, regexp_extract(url,'^https?://[^/]*(/[^?#]*)',1) AS path FROM pages)""")
def _(r):
    path = F.regexp_extract("url", r"^https?://[^/]*(/[^?#]*)", 1)
    return r.table("pages").select(
        "page_id", keys.unsafe_key(F.col("url")).alias("unsafe_url"), (~keys.outside_root(path, "/en")).alias("below")
    )


@query("x10_content_types", """SELECT id, CASE WHEN k LIKE '%.avif' THEN 'image/avif' WHEN k LIKE '%.jpeg' THEN 'image/jpeg' ELSE 'image/webp' END AS content_type,
  split_part(k,'/',3) AS third, left(sha,20) AS head FROM (SELECT id, display_key AS k, display_sha256 AS sha FROM keyed_pictures)""", ("keyed_pictures",))
def _(r):
    return r.keyed_pictures.select(
        "id", keys.content_type(F.col("display_key")).alias("content_type"),
        F.split_part("display_key", F.lit("/"), F.lit(3)).alias("third"), F.left("display_sha256", F.lit(20)).alias("head"),
    )


@query("x11_set_digest", f"""SELECT ({tree_sql("SELECT sha256(json_object('lang',lang,'text',text)::VARCHAR) AS h FROM documents")}) AS digest""")
def _(r):
    return hashing.set_digest(r.table("documents"), ["lang", "text"])


@query("x11_digest_nodes", """SELECT prefix, sha256(string_agg(h||':'||n, chr(10) ORDER BY h||':'||n)) AS digest FROM (
  SELECT substr(h,1,12) AS prefix, h, count(*) AS n FROM (SELECT sha256(json_object('lang',lang,'text',text)::VARCHAR) AS h FROM documents) GROUP BY 1, 2) GROUP BY 1""")
def _(r):
    """The lowest level of the tree; two tables differ below the prefixes that differ."""
    return hashing.digest_nodes(r.table("documents"), ["lang", "text"], 12)


def _expires(r):
    return signing.expiry(F.lit(float(NOW_S)) + F.col("page_id"), F.col("page_id") * 1000)


@query("x14_expiry", f"""SELECT page_id, CAST(ceil(({NOW_S}+page_id)/300) AS BIGINT)*300 +
  CASE WHEN page_id*1000 BETWEEN 300 AND 86400 THEN page_id*1000 ELSE 21600 END AS expires FROM pages""")
def _(r):
    return r.table("pages").select("page_id", _expires(r).alias("expires"))


def _hmac_sql(message: str) -> str:
    inner = "".join(f"\\x{b ^ 0x36:02X}" for b in SECRET.ljust(64, b"\0"))
    outer = "".join(f"\\x{b ^ 0x5C:02X}" for b in SECRET.ljust(64, b"\0"))
    return (
        f"translate(rtrim(base64(unhex(sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({message})))))),'='),'+/','-_')"
    )


@query("x12_signed_links", f"""SELECT id, {_hmac_sql("'media:'||display_key||':'||(1900000000+o_orderkey)")} AS signature FROM keyed_pictures""", ("keyed_pictures",))
def _(r):
    expires = F.lit(NOW_S) + F.col("o_orderkey")
    path = keys.encode_segments(F.col("display_key"))
    return r.keyed_pictures.select("id", signing.link_signature(path, expires, SECRET).alias("signature"))


@query("x13_verify_links", f"""SELECT id, CASE WHEN o_orderstatus='F' AND e > {NOW_S}+5000 THEN e END AS expiry
  FROM (SELECT *, {NOW_S}+o_orderkey AS e FROM keyed_pictures)""", ("keyed_pictures",))
def _(r):
    """Links of finished orders are genuine; the others were signed for another expiry."""
    e = F.lit(NOW_S) + F.col("o_orderkey")
    path = keys.encode_segments(F.col("display_key"))
    claimed = F.when(F.col("o_orderstatus") == "F", e).otherwise(e + 1)
    url = F.concat(
        F.lit("https://media.example/"), path, F.lit("?expires="), claimed.cast("string"),
        F.lit("&signature="), signing.link_signature(path, e, SECRET),
    )
    signed = r.keyed_pictures.select("id", url.alias("url"))
    return signed.select("id", signing.verified_expiry(F.col("url"), F.lit(NOW_S + 5000), SECRET).alias("expiry"))


@query("x15_segment_encoding", "SELECT p_partkey, url_encode(p_name)||'/'||url_encode(p_type) AS encoded FROM part")
def _(r):
    return r.table("part").select("p_partkey", keys.encode_segments(F.concat_ws("/", "p_name", "p_type")).alias("encoded"))


@query("x16_cursor_column", """SELECT id, translate(rtrim(base64(encode(json_object('v',2,'s','album','f','person-a','p',album_position,'i',id)::VARCHAR)),'='),'+/','-_') AS cursor
  FROM pictures""", ("pictures",))
def _(r):
    return r.pictures.select(
        "id", cursor_column("album", F.col("id"), position=F.col("album_position"), person="person-a").alias("cursor")
    )


@query("x17_pattern_checks", """SELECT page_id, regexp_full_match(host,'[a-z0-9]+(-[a-z0-9]+)*') AND length(host) BETWEEN 1 AND 128 AS slug_ok,
  regexp_full_match(substr(md5(url),1,(page_id%40)::INTEGER),'[a-f0-9]{8,64}') AS seed_ok FROM (SELECT *, split_part(split_part(url,'/',3),'.',1) AS host FROM pages)""")
def _(r):
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1))
    seed = F.substring(F.md5("url"), F.lit(1), (F.col("page_id") % 40).cast("int"))
    return r.table("pages").select("page_id", keys.valid_slug(host).alias("slug_ok"), keys.valid_seed(seed).alias("seed_ok"))


@query("x18_box_iou", """SELECT id, round(CASE WHEN u>0 THEN i/u ELSE 0 END,6) AS iou FROM (SELECT id, i, bbox_width*bbox_height+0.25-i AS u FROM (
  SELECT *, greatest(0,least(bbox_x+bbox_width,0.55)-greatest(bbox_x,0.05))*greatest(0,least(bbox_y+bbox_height,0.55)-greatest(bbox_y,0.05)) AS i FROM faces))""", ("faces",))
def _(r):
    fixed = [F.lit(0.05), F.lit(0.05), F.lit(0.5), F.lit(0.5)]
    box = [F.col(c) for c in ("bbox_x", "bbox_y", "bbox_width", "bbox_height")]
    return r.faces.select("id", F.round(geometry.iou(*box, *fixed), 6).alias("iou"))


@query("x18_unit_box", """SELECT id, round(least(1,greatest(0,(width_px*9.0e0-100)/1000)),6) AS bbox_x, round(least(1,greatest(1/1000,height_px*10/1000)),6) AS bbox_width
  FROM faces""", ("faces",))
def _(r):
    box = geometry.unit_box(
        F.col("width_px") * 9.0 - 100, F.lit(0.0), F.col("height_px") * 10, F.lit(5.0), F.lit(1000.0), F.lit(1000.0)
    )
    return r.faces.select("id", F.round(box["bbox_x"], 6).alias("bbox_x"), F.round(box["bbox_width"], 6).alias("bbox_width"))


@query("x19_quality_score", """SELECT id, round(greatest(0,least(1,detection_score*least(1,least(width_px,height_px)/160))),12) AS q FROM faces""", ("faces",))
def _(r):
    q = geometry.quality_score(F.col("detection_score"), F.col("width_px"), F.col("height_px"))
    return r.faces.select("id", F.round(q, 12).alias("q"))


@query("x20_l2_normalize", """SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x*x))),4) AS before,
  CASE WHEN vec_id=0 THEN NULL ELSE 1.0e0 END AS after FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x*vec_id) AS e FROM embeddings)""")
def _(r):
    scaled = r.table("embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * F.col("vec_id")).alias("e")
    )
    return scaled.select(
        "vec_id", F.round(vectors.norm(F.col("e")), 4).alias("before"),
        F.round(vectors.norm(vectors.l2_normalize(F.col("e"))), 4).alias("after"),
    )


@query("x20_dot_product", """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),6) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1""")
def _(r):
    e = r.table("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("x21_capture_time", """SELECT event_id, CASE WHEN event_type IN ('click','view') THEN strftime(ts,'%Y-%m-%dT%H:%M:%S')
  WHEN event_type='error' THEN '2001-01-01T00:00:00' ELSE strftime(make_timestamp((CASE WHEN event_id%5=0 THEN event_id ELSE user_id END)*1000000),'%Y-%m-%dT%H:%M:%S') END AS value,
  CASE WHEN event_type IN ('click','view','error') THEN 'exif' ELSE 'filesystem' END AS source FROM events""")
def _(r):
    kind = F.col("event_type")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    original = F.when(kind.isin("click", "view"), ts).when(kind == "error", "not a date")
    created = F.when(kind == "error", "2001-01-01T00:00:00")
    mtime = F.when(F.col("event_id") % 5 == 0, F.col("event_id")).otherwise(F.col("user_id")) * 1000
    taken = coerce.captured_at(original, created, mtime, F.lit(0))
    return r.table("events").select(
        "event_id", F.date_format(taken["value"], "yyyy-MM-dd'T'HH:mm:ss").alias("value"), taken["source"].alias("source")
    )


@query("x22_finite_numbers", """SELECT event_id, CASE WHEN event_type='view' THEN NULL WHEN event_type='click' THEN 0 ELSE value END AS iso FROM events""")
def _(r):
    """Views carry text that is no finite number, clicks a written null."""
    raw = F.when(F.col("event_type") == "view", F.element_at(F.array(F.lit("Infinity"), F.lit("NaN"), F.lit("f/8")), (F.col("event_id") % 3 + 1).cast("int"))).when(
        F.col("event_type") == "click", F.lit(None)
    ).otherwise(F.col("value").cast("string"))
    number = coerce.finite_number(raw, explicit_null_is_zero=F.col("event_type") == "click")
    return r.table("events").select("event_id", number.alias("iso"))


@query("x23_crop_side", """SELECT event_id, CASE WHEN k BETWEEN 64 AND 1024 THEN k END AS side FROM (SELECT event_id, json_extract(props,'$.k')::INTEGER AS k FROM events)""")
def _(r):
    config = F.concat(F.lit('{"crop": {"side_px": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    return r.table("events").select("event_id", coerce.crop_side(config).alias("side"))


@query("x24_scale_plan", """SELECT id, w AS scaled_width, h AS scaled_height, min(step) AS step FROM (SELECT id, step,
  greatest(1,round_even(width*s,0))::INTEGER AS w, greatest(1,round_even(height*s,0))::INTEGER AS h FROM (
  SELECT id, width, height, step::INTEGER AS step, least(1.0e0, edge/greatest(width,height)) AS s FROM pictures CROSS JOIN (VALUES (0,640),(1,1280),(2,2560),(3,5120)) e(step,edge))) GROUP BY 1,2,3""", ("pictures",))
def _(r):
    from ..plans.scan import scale_plan

    return scale_plan(r.pictures, [640, 1280, 2560, 5120]).select("id", "scaled_width", "scaled_height", "step")


@query("x25_human_bytes", """SELECT p_partkey, CASE WHEN b>=1073741824 THEN printf('%.1f GiB',floor(b/1073741824e0*10+0.5)/10) WHEN b>=1048576 THEN printf('%.1f MiB',floor(b/1048576e0*10+0.5)/10)
  WHEN b>=1024 THEN printf('%.1f KiB',floor(b/1024e0*10+0.5)/10) ELSE b||' B' END AS size FROM (SELECT p_partkey, p_partkey*p_partkey*p_size AS b FROM part)""")
def _(r):
    size = F.col("p_partkey") * F.col("p_partkey") * F.col("p_size")
    return r.table("part").select("p_partkey", text.human_bytes(size).alias("size"))


@query("x26_safe_integers", """SELECT event_id, CASE WHEN event_type='error' THEN NULL ELSE event_id*9007199254 END AS n FROM events
  WHERE event_id*9007199254<=9007199254740991 UNION ALL SELECT event_id, NULL FROM events WHERE event_id*9007199254>9007199254740991""")
def _(r):
    raw = (F.col("event_id") * 9007199254).cast("string")
    spoiled = F.when(F.col("event_type") == "error", F.concat(raw, F.lit("x"))).otherwise(raw)
    return r.table("events").select("event_id", coerce.safe_integer(spoiled, minimum=0).alias("n"))


@query("x27_record_normalization", """SELECT p_partkey, CASE p_size%5 WHEN 0 THEN 'labeled' WHEN 1 THEN 'ignored' WHEN 2 THEN 'unknown' WHEN 3 THEN 'labeled' ELSE 'unreviewed' END AS status,
  CASE WHEN p_size%2=0 THEN p_size ELSE p_partkey END AS face_count FROM part""")
def _(r):
    """Records name their status, or flags, or only a person, or nothing."""
    m = F.col("p_size") % 5
    status = coerce.status_from_flags(
        F.when(m == 0, "LABELED").when(m == 4, "nonsense"), m == 1, m == 2, F.when(m == 3, F.col("p_name"))
    )
    count = coerce.first_present(F.when(F.col("p_size") % 2 == 0, F.col("p_size")).cast("bigint"), F.col("p_partkey"))
    return r.table("part").select("p_partkey", status.alias("status"), count.alias("face_count"))


@query("f9_null_safe_inequality", "SELECT id FROM pictures WHERE captured_at IS DISTINCT FROM TIMESTAMP '1997-05-28'", ("pictures",))
def _(r):
    day = F.to_timestamp(F.lit("1997-05-28 00:00:00"))
    return r.pictures.where(~F.col("captured_at").eqNullSafe(day)).select("id")


# Ingest -------------------------------------------------------------------------

@query("w6_keep_one_per_content", """SELECT sha256, path FROM (SELECT sha256(text) AS sha256, source||'/'||doc_id AS path,
  row_number() OVER (PARTITION BY sha256(text) ORDER BY source||'/'||doc_id) AS n FROM documents) WHERE n=1""")
def _(r):
    return ingest.distinct_content(_files(r)).select("sha256", "path")


def _files(r):
    return r.table("documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        hashing.sha256_hex(F.col("text")).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"), "lang", "doc_id",
    )


@query("p2_build_once_fan_out", """SELECT source||'/'||doc_id AS path, min(source||'/'||doc_id) OVER (PARTITION BY sha256(text)) AS built_from FROM documents""")
def _(r):
    files = _files(r)
    built = ingest.distinct_content(files).select("sha256", F.col("path").alias("built_from"))
    return ingest.fan_out(files, built).select("path", "built_from")


@query("w7_last_wins", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events
  WHERE event_type<>'error') WHERE n=1""")
def _(r):
    log = r.table("events").select(
        F.col("user_id").alias("signature"), F.col("event_id").alias("seq"), "event_type",
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("type"),
    )
    return ingest.latest_state(log).select(F.col("signature").alias("user_id"), F.col("seq").alias("event_id"), "event_type")


@query("p1_incremental_split", """SELECT id, (o_orderstatus<>'P' AND o_orderstatus<>'O') AS resumed FROM pictures""", ("pictures",))
def _(r):
    """State knows all but pending pictures; open ones lost an object."""
    k = r.keyed_pictures
    inventory = k.select("id", F.col("source_fingerprint").alias("signature"))
    state = k.where(F.col("o_orderstatus") != "P").select(
        F.col("source_fingerprint").alias("signature"), "thumb_key", "thumb_bytes", "display_key", "display_bytes"
    )
    wrong = F.when(F.col("o_orderstatus") == "O", F.col("display_bytes") + 1).otherwise(F.col("display_bytes"))
    objects = k.select(F.col("thumb_key").alias("object_key"), F.col("thumb_bytes").alias("bytes")).unionByName(
        k.select(F.col("display_key").alias("object_key"), wrong.alias("bytes"))
    )
    resumed, todo = ingest.split_work(inventory, state, objects)
    return resumed.select("id", F.lit(True).alias("resumed")).unionByName(todo.select("id", F.lit(False).alias("resumed")))


PROFILE = ('{"profile_version":1,"tool_version":"1.0.0","encoder":{"sharp":"0.34","libvips":"not-loaded"},"album_id":"a","prefix":"gallery",'
           '"thumb":{"max_edge":640,"format":"webp","quality":QQ},"display":{"max_edge":2048,"format":"webp","quality":82},"auto_orient":true,'
           '"colorspace":"srgb","source_metadata_preserved":false,"cache_control":"public, max-age=31536000, immutable"}')


@query("p1_profile_change", f"""SELECT id, o_orderstatus<>'O' AS resumed, sha256('{PROFILE}'.replace('QQ', CASE WHEN o_orderstatus='O' THEN '80' ELSE '74' END)) AS profile FROM pictures""", ("pictures",))
def _(r):
    """Everything was built; then the thumbnails of open orders get another quality."""
    def settings(quality):
        return ingest.derivative_settings(
            album_id="a", prefix=PREFIX, image_format="webp", thumb_size=640, thumb_quality=quality, display_size=2048,
            display_quality=82, encoder={"sharp": "0.34"},
        )

    k = r.keyed_pictures.withColumns({"relative_path": F.col("original_filename"), "bytes": F.col("thumb_bytes"), "mtime_ms": F.col("o_orderkey") * 1000})
    built = ingest.sign_inventory(k, settings(74))
    open_ = F.col("o_orderstatus") == "O"
    inventory = ingest.sign_inventory(k.where(open_), settings(80)).unionByName(built.where(~open_))
    objects = k.select(F.col("thumb_key").alias("object_key"), F.col("thumb_bytes").alias("bytes")).unionByName(
        k.select(F.col("display_key").alias("object_key"), F.col("display_bytes").alias("bytes"))
    )
    state = built.select("signature", "thumb_key", "thumb_bytes", "display_key", "display_bytes")
    resumed, todo = ingest.split_work(inventory, state, objects)
    profile = F.when(open_, ingest.profile_fingerprint(settings(80))).otherwise(ingest.profile_fingerprint(settings(74)))
    marked = [f.select("id", F.lit(done).alias("resumed"), profile.alias("profile")) for f, done in ((resumed, True), (todo, False))]
    return marked[0].unionByName(marked[1])


def _media(r):
    k = r.keyed_pictures
    return k.select(
        F.col("source_fingerprint").alias("sha256"), F.col("width").alias("source_width"), F.col("height").alias("source_height"),
        F.element_at(F.array(F.lit("webp"), F.lit("avif"), F.lit("jpeg")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("format"),
        "thumb_sha256", F.lit(640).alias("thumb_width"), F.lit(480).alias("thumb_height"), "thumb_bytes",
        "display_sha256", F.lit(2560).alias("display_width"), F.lit(1920).alias("display_height"), "display_bytes",
        F.lit(None).cast("string").alias("blur_data_url"), F.lit("#aabbcc").alias("dominant_color"),
        F.struct(
            F.lit("Make").alias("camera_make"), F.lit(None).cast("string").alias("camera_model"), F.lit(None).cast("string").alias("lens_model"),
            F.col("o_orderkey").cast("double").alias("iso"), F.lit(float("nan")).alias("aperture"),
            F.lit(0.01).alias("exposure_seconds"), F.lit(35.0).alias("focal_length_mm"),
            F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("date_original"), F.lit(None).cast("string").alias("date_created"),
        ).alias("meta"),
    )


def _records(r):
    """Every photo exists at two paths, so each content occurs twice."""
    files = r.pictures.select(
        F.col("source_fingerprint").alias("sha256"), F.explode(F.array(F.lit("b/"), F.lit("a/"))).alias("dir"),
        F.col("original_filename").alias("file_name"), F.col("thumb_bytes").alias("bytes"),
        (F.col("o_orderkey") * 1000).alias("mtime_ms"), F.lit(0).alias("birthtime_ms"),
    ).withColumn("path", F.concat("dir", "file_name"))
    return ingest.photo_records(files, _media(r), album_id="all", prefix=PREFIX)


CAPTURED = "CASE WHEN captured_at IS NULL AND o_orderkey>0 THEN make_timestamp(o_orderkey*1000000) ELSE captured_at END"
NATURAL = "regexp_replace(regexp_replace(lower(original_filename),'(\\d+)','00000000000000000000\\1','g'),'0*(\\d{20})(\\D|$)','\\1\\2','g')"
RECORD = f"""SELECT 'p_'||substr(source_fingerprint,1,32) AS id, original_filename, thumb_key,
  CASE WHEN captured_at IS NULL THEN make_timestamp(o_orderkey*1000000) ELSE captured_at END AS t,
  CASE WHEN captured_at IS NULL THEN 'filesystem' ELSE 'exif' END AS captured_at_source, o_orderkey, thumb_bytes, display_key, display_bytes FROM keyed_pictures"""


@query("p3_photo_records", f"""SELECT id, thumb_key, captured_at_source, strftime(t,'%Y-%m-%dT%H:%M:%S') AS taken, o_orderkey::DOUBLE AS iso,
  CAST(NULL AS DOUBLE) AS aperture FROM ({RECORD}) CROSS JOIN (VALUES (1),(2)) twice(x)""", ("keyed_pictures",))
def _(r):
    return _records(r).select(
        "id", "thumb_key", "captured_at_source", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss").alias("taken"),
        F.col("metadata.iso").alias("iso"), F.col("metadata.aperture").alias("aperture"),
    )


@query("o11_album_positions", f"""SELECT id, (row_number() OVER (ORDER BY t, {NATURAL}, id)-1)::INTEGER AS album_position FROM ({RECORD})""", ("keyed_pictures",))
def _(r):
    return ingest.album_manifest(_records(r)).select("id", "album_position")


@query("p5_upload_plan", f"""SELECT photo_id, kind, object_key, local_path, content_type, bytes FROM (
  SELECT id AS photo_id, kind, k AS object_key, '/objects/'||k AS local_path,
  CASE WHEN k LIKE '%.avif' THEN 'image/avif' WHEN k LIKE '%.jpeg' THEN 'image/jpeg' ELSE 'image/webp' END AS content_type, bytes FROM (
  SELECT id, 'thumb' AS kind, thumb_key AS k, thumb_bytes AS bytes FROM ({RECORD}) UNION ALL SELECT id, 'display', display_key, display_bytes FROM ({RECORD})))""", ("keyed_pictures",))
def _(r):
    plan = ingest.upload_plan(ingest.unique_pictures(_records(r)), "/objects")
    return plan.select("photo_id", "kind", "object_key", "local_path", "content_type", "bytes")


@query("a18_run_counters", """SELECT count(*) AS discovered_count, count(DISTINCT CASE WHEN event_type<>'error' THEN user_id END) AS imported_count,
  count_if(event_type='view') AS skipped_count, count_if(event_type='error') AS failed_count, count_if(event_type='error')=0 AS complete_source_set,
  CASE WHEN count_if(event_type='error')>0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM events""")
def _(r):
    return ingest.run_counters(_outcomes(r))


def _outcomes(r):
    kind = F.col("event_type")
    return r.table("events").select(
        F.when(kind == "error", "failed").when(kind == "view", "resumed").otherwise("built").alias("outcome"),
        F.col("user_id").alias("photo_id"),
    )


@query("p4_run_document", """SELECT count(*) AS photo_count, strftime(min(captured_at),'%Y-%m-%d') AS lo, strftime(max(captured_at),'%Y-%m-%d') AS hi,
  (SELECT count(*) FROM events) AS discovered_count, 'completed_with_errors' AS status FROM pictures""", ("pictures",))
def _(r):
    doc = ingest.run_document(r.pictures, ingest.run_counters(_outcomes(r)))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return doc.select("photo_count", day("captured_at_min").alias("lo"), day("captured_at_max").alias("hi"), "discovered_count", "status")


@query("a15_plan_totals", "SELECT count(*)*2 AS objects, sum(thumb_bytes+display_bytes)::BIGINT AS bytes FROM pictures", ("pictures",))
def _(r):
    from ..plans.upload import totals

    return totals(ingest.upload_plan(r.keyed_pictures, "/objects"))


@query("o13_plan_preview", """SELECT object_key, (SELECT count(*)*2-5 FROM pictures) AS more FROM (SELECT thumb_key AS object_key FROM keyed_pictures
  UNION ALL SELECT display_key FROM keyed_pictures) ORDER BY object_key LIMIT 5""", ("keyed_pictures",))
def _(r):
    from ..plans.upload import preview

    head, more = preview(ingest.upload_plan(r.keyed_pictures, "/objects"))
    return head.select("object_key").crossJoin(F.broadcast(more))


@query("o14_first_files", f"SELECT path FROM (SELECT source||'/'||doc_id AS path FROM documents) ORDER BY {NATURAL.replace('original_filename','path')}, path LIMIT 100")
def _(r):
    from ..sources.files import first_files

    return first_files(_files(r).withColumn("relative_path", F.col("path")), 100).select("path")


def _ledger(r):
    """Uploads of the finished orders' thumbnails, plus rows of another bucket."""
    from ..plans.upload import with_fingerprint

    plan = with_fingerprint(ingest.upload_plan(r.keyed_pictures, "/objects", keep=("o_orderstatus", "o_orderkey")))
    stale = F.when(F.col("o_orderstatus") == "O", F.reverse("upload_fingerprint")).otherwise(F.col("upload_fingerprint"))
    return plan.where(F.col("kind") == "thumb").select(
        F.col("o_orderkey").alias("seq"), F.lit("uploaded").alias("type"), F.lit("acct").alias("account_id"), F.lit("prof").alias("profile"),
        F.when(F.col("o_orderstatus") == "P", "other").otherwise("main").alias("bucket"), F.lit("t0").alias("bucket_created_at"),
        "object_key", stale.alias("upload_fingerprint"),
    )


TARGET = dict(account_id="acct", profile="prof", bucket="main", bucket_created_at="t0")


@query("p6_ledger_of_target", "SELECT thumb_key AS object_key FROM keyed_pictures WHERE o_orderstatus<>'P'", ("keyed_pictures",))
def _(r):
    from ..plans.upload import uploaded

    return uploaded(_ledger(r), **TARGET).select("object_key")


@query("j14_ledger_matches", "SELECT thumb_key AS object_key FROM keyed_pictures WHERE o_orderstatus='F'", ("keyed_pictures",))
def _(r):
    from ..plans.upload import ledger_matches, uploaded

    plan = ingest.upload_plan(r.keyed_pictures, "/objects")
    return ledger_matches(plan, uploaded(_ledger(r), **TARGET)).select("object_key")


@query("p7_pending_uploads", """SELECT display_key AS object_key FROM keyed_pictures UNION ALL
  SELECT thumb_key FROM keyed_pictures WHERE o_orderstatus<>'F' OR o_orderkey%10=3""", ("keyed_pictures",))
def _(r):
    """Remote copies of every tenth thumbnail are truncated."""
    from ..plans.upload import pending, uploaded

    plan = ingest.upload_plan(r.keyed_pictures, "/objects")
    remote = ingest.upload_plan(r.keyed_pictures, "/objects", keep=("o_orderkey",)).select(
        "object_key", "sha256", F.when(F.col("o_orderkey") % 10 == 3, F.col("bytes") - 1).otherwise(F.col("bytes")).alias("bytes")
    )
    return pending(plan, uploaded(_ledger(r), **TARGET), remote).select("object_key")


@query("u2_plan_minus_verified", "SELECT display_key AS object_key FROM keyed_pictures", ("keyed_pictures",))
def _(r):
    from ..plans.upload import verified

    plan = ingest.upload_plan(r.keyed_pictures, "/objects")
    done = verified(plan.where(F.col("kind") == "thumb"), plan)
    return plan.join(done, "object_key", "left_anti").select("object_key")
