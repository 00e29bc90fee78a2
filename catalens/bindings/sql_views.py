"""The views of :mod:`catalens.bindings.views` in DuckDB SQL, for checking results."""

from __future__ import annotations

from catalens.bindings.views import MIMES
from catalens.functions.mime import MIME_GROUPS


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def in_group(column: str, group: str) -> str:
    return f"coalesce({column} IN ({sql_list(MIME_GROUPS[group])}), false)"


def media_type(column: str) -> str:
    cases = " ".join(
        f"WHEN {in_group(column, t)} THEN '{t}'" for t in ("image", "video", "audio", "document")
    )
    return f"CASE {cases} ELSE 'other' END"


def mime_at(n: str) -> str:
    return f"([{sql_list(MIMES)}])[CAST(({n}) % 42 + 1 AS INTEGER)]"


def media_path(n: str) -> str:
    return f"'/media/f' || ({n}) || CASE ({n}) % 3 WHEN 0 THEN '.CR2' WHEN 1 THEN '' ELSE '.tar.x' END"


def date_text(n: str) -> str:
    zone = f"CASE ({n}) % 4 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+02:00' ELSE '.25-05:00' END"
    return (
        f"printf('%04d:%02d:%02d %02d:%02d:%02d%s', 2000 + ({n}) % 25, 1 + ({n}) % 12, "
        f"1 + ({n}) % 28, ({n}) % 24, ({n}) % 60, ({n}) % 59, {zone})"
    )


def tags(n: str) -> str:
    """Select list of all tags of file number ``n``."""
    columns = {
        "FileName": "'f' || {n} || '.jpg'",
        "MIMEType": mime_at("{n}"),
        "Make": "CASE {n} % 5 WHEN 1 THEN '' WHEN 2 THEN 'Apple' WHEN 3 THEN 'Canon' "
        "WHEN 4 THEN 'Sony' END",
        "DeviceManufacturer": "CASE WHEN {n} % 11 > 5 THEN 'Acme' WHEN {n} % 11 = 5 THEN 'Apple' "
        "WHEN {n} % 11 = 4 THEN '' END",
        "Model": "CASE {n} % 13 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'M' || ({n} % 13) END",
        "DeviceModelName": "CASE WHEN {n} % 17 > 3 THEN 'D' || ({n} % 17) END",
        "SerialNumber": "CASE WHEN {n} % 19 > 7 THEN 'S' || chr(0) || {n} WHEN {n} % 19 = 7 THEN '' END",
        "InternalSerialNumber": "CASE WHEN {n} % 23 > 10 THEN 'I' || chr(0) || {n} "
        "WHEN {n} % 23 = 10 THEN '' END",
        "DeviceSerialNo": "CASE WHEN {n} % 29 > 9 THEN 'N' || {n} END",
        "FileNumber": "CASE WHEN {n} % 31 > 9 THEN '100-' || {n} END",
        "ImageWidth": "CAST(CASE {n} % 37 WHEN 0 THEN NULL WHEN 1 THEN 0 "
        "ELSE 100 + {n} * 7 % 900 END AS INTEGER)",
        "ImageHeight": "CAST(CASE {n} % 41 WHEN 0 THEN NULL WHEN 1 THEN 0 "
        "ELSE 100 + {n} * 11 % 900 END AS INTEGER)",
        "FrameRate": "CAST(CASE WHEN {n} % 43 > 15 THEN {n} % 43 WHEN {n} % 43 = 15 THEN 0 END AS DOUBLE)",
        "VideoFrameRate": "CASE WHEN {n} % 47 > 19 THEN CAST({n} % 47 AS DOUBLE) + 0.5::DOUBLE END",
        "ISO": "CASE WHEN {n} % 53 > 9 THEN CAST({n} % 53 * 100 AS DOUBLE) END",
        "ExposureTime": "1.0::DOUBLE / CAST(1 + {n} % 59 AS DOUBLE)",
        "FrameCount": "CASE WHEN {n} % 61 > 20 THEN {n} % 61 WHEN {n} % 61 = 20 THEN 0 END",
        "LtcChangeTableLtcChangeFrameCount": "CASE WHEN {n} % 67 > 29 THEN {n} % 67 END",
        "Duration": "CASE WHEN {n} % 71 > 19 THEN CAST({n} % 71 AS DOUBLE) * 0.25::DOUBLE END",
        "Orientation": "{n} % 73 % 9",
        "GPSLongitude": "CASE WHEN {n} % 79 > 14 THEN CAST({n} * 7 % 36000 - 18000 AS DOUBLE) / 100::DOUBLE "
        "WHEN {n} % 79 > 9 THEN 0::DOUBLE END",
        "GPSLatitude": "CASE WHEN {n} % 83 > 14 THEN CAST({n} * 11 % 18000 - 9000 AS DOUBLE) / 100::DOUBLE "
        "WHEN {n} % 83 > 9 THEN 0::DOUBLE END",
        "GPSAltitude": "CASE WHEN {n} % 89 > 29 THEN CAST({n} % 89 AS DOUBLE) * 1.5::DOUBLE END",
        "GPSDOP": "CASE WHEN {n} % 97 > 49 THEN {n} % 97 WHEN {n} % 97 > 29 THEN 0 END",
        "Country": "CASE WHEN {n} % 101 > 49 THEN 'C' || ({n} % 101) END",
        "State": "CASE WHEN {n} % 103 > 49 THEN 'S' || ({n} % 103) END",
        "City": "CASE WHEN {n} % 107 > 49 THEN 'T' || ({n} % 107) END",
        "Landmark": "CASE WHEN {n} % 109 > 59 THEN 'L' || ({n} % 109) WHEN {n} % 109 > 29 THEN '---' END",
        "GPSAreaInformation": "CASE WHEN {n} % 113 > 49 THEN 'A' || ({n} % 113) END",
        "GPSDateTime": "CASE WHEN {n} % 127 > 69 THEN " + date_text("{n}") + " WHEN {n} % 127 > 59 "
        "THEN 'bad date' WHEN {n} % 127 > 39 THEN '0000:00:00 00:00:00Z' WHEN {n} % 127 > 29 THEN '' END",
        "DateTimeOriginal": "CASE WHEN {n} % 131 > 64 THEN " + date_text("{n} + 1") + " WHEN {n} % 131 > 59 "
        "THEN 'bad date' WHEN {n} % 131 > 49 THEN '    :  :     :  :  ' WHEN {n} % 131 > 39 THEN '' END",
        "CreationDateValue": "CASE WHEN {n} % 137 > 89 THEN " + date_text("{n} + 2") + " END",
        "CreateDate": "CASE WHEN {n} % 139 > 49 THEN " + date_text("{n} + 3") + " END",
        "CreationDate": "CASE WHEN {n} % 149 > 59 THEN " + date_text("{n} + 4")
        + " WHEN {n} % 149 > 54 THEN '2001-02-03' END",
        "Compression": "CASE {n} % 13 % 3 WHEN 0 THEN 'dvsd' WHEN 1 THEN 'h264' END",
        "ImageSize": "CASE WHEN {n} % 151 > 89 THEN {n} || 'x' || {n} WHEN {n} % 151 > 29 THEN {n} || ' ' || {n} END",
    }
    return ",\n  ".join(f"{text.replace('{n}', n)} AS {name}" for name, text in columns.items())


ANGLE = "nullif(regexp_extract(angle_text, '^\\s*([+-]?[0-9]+)', 1), '')"

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "files": ([], """
  SELECT doc_id AS id, '/docs/' || source || '/' || doc_id AS path, 'text/plain' AS mimetype,
    encode(text) AS content, octet_length(encode(text)) AS length FROM documents
  UNION ALL
  SELECT page_id, '/pages/' || page_id || '/' || url, 'text/html', encode(html),
    octet_length(encode(html)) FROM pages"""),
    "mimes": ([], f"""
  SELECT p_partkey AS id, {media_path("p_partkey")} AS path,
    CASE WHEN p_partkey % 5 <> 0 THEN {mime_at("p_partkey")} END AS exif_mimetype,
    CASE WHEN p_partkey % 7 <> 0 THEN {mime_at("p_partkey * 11 + 3")} END AS fallback_mimetype,
    p_partkey % 5 <> 0 AS exif_ok
  FROM part"""),
    "media": ([], f"""
  SELECT {media_path("p_partkey")} AS path, {mime_at("p_partkey")} AS mimetype,
    CAST(CASE p_partkey // 42 % 5 WHEN 0 THEN NULL WHEN 1 THEN 0
      ELSE 16 + p_partkey * 37 % 4000 END AS INTEGER) AS width,
    CAST(CASE p_partkey // 42 % 7 WHEN 0 THEN NULL WHEN 1 THEN 0
      ELSE 16 + p_partkey * 53 % 3000 END AS INTEGER) AS height,
    CASE p_partkey % 13 % 3 WHEN 0 THEN 'dvsd' WHEN 1 THEN 'h264' END AS compression
  FROM part"""),
    "exif": ([], f"""
  SELECT n AS id,
  {tags("n")}
  FROM (SELECT l_orderkey * 7 + l_linenumber AS n FROM lineitem)"""),
    "exif_dates": ([], """
  SELECT id, CASE WHEN id % 11 > 1 THEN d WHEN id % 11 = 1 THEN '' END AS GPSDateTime,
    CASE WHEN id % 7 > 2 THEN replace(d, ':', '/') WHEN id % 7 = 2 THEN d
      WHEN id % 7 = 1 THEN '    :  :     :  :  ' END AS DateTimeOriginal
  FROM (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') ||
    CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+02:00' ELSE '.25-05:00' END AS d
    FROM orders)"""),
    # Tags of the files that have a dump; exif_ok is false where the dump was cut off.
    "dumped": (["files"], f"""
  SELECT path, id, id % 9 <> 0 AS exif_ok,
  {tags("id")}
  FROM files WHERE id % 10 <> 9"""),
    "mime_feed": (["files"], """
  SELECT path, mimetype FROM files WHERE id % 8 <> 7"""),
    "requests": ([], f"""
  SELECT event_id AS request_id, ts, user_id AS id, {media_path("event_id // 4")} AS filename,
    CASE WHEN event_type = 'view' THEN 'image' WHEN event_type = 'click' THEN 'video'
      WHEN event_type = 'purchase' THEN 'audio' WHEN event_type = 'signup' THEN 'document'
      WHEN k % 5 = 4 THEN 'sticker' ELSE '*' END AS type,
    CASE k % 4 WHEN 1 THEN 0 WHEN 2 THEN 20 WHEN 3 THEN 320 END AS width,
    CASE k // 4 % 3 WHEN 1 THEN 20 WHEN 2 THEN 240 END AS height,
    CASE event_id % 8 WHEN 1 THEN '0' WHEN 2 THEN '90' WHEN 3 THEN '-90' WHEN 4 THEN '180'
      WHEN 5 THEN '270' WHEN 6 THEN '90abc' WHEN 7 THEN '45' END AS angle_text,
    CASE event_id // 16 % 4 WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN '' END AS mirror,
    CASE event_id // 64 % 3 WHEN 1 THEN 0::DOUBLE WHEN 2 THEN 12.5::DOUBLE END AS timeindex,
    CASE event_id // 192 % 3 WHEN 1 THEN true WHEN 2 THEN false END AS deinterlace
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""),
    "keyed": (["requests"], f"""
  SELECT *, '/cache/' || name AS filepath FROM (
    SELECT *, CASE WHEN error IS NULL THEN id || '_w' || coalesce(width, 0) || '_h' ||
      coalesce(height, 0) || '_s' || CASE WHEN width IS NOT DISTINCT FROM height THEN 1 ELSE 0 END ||
      '_a' || coalesce(angle, 0) || '_m' || CASE WHEN mirror <> '' THEN 1 ELSE 0 END || '.' ||
      CASE type WHEN 'image' THEN 'jpg' WHEN 'document' THEN 'pdf' WHEN '*' THEN '' ELSE 'webm' END
      END AS name
    FROM (
      SELECT *, CASE WHEN abs(parsed) IN (90, 180, 270) THEN parsed END AS angle,
        CASE WHEN parsed <> 0 AND abs(parsed) NOT IN (90, 180, 270)
          THEN 'Valid angle values are: -270, -180, -90, 90, 180 and 270'
        WHEN type = 'sticker' THEN 'Unknown format type, sticker' END AS error
      FROM (SELECT *, TRY_CAST({ANGLE} AS INTEGER) AS parsed FROM requests)))"""),
    "cached": (["keyed"], """
  SELECT DISTINCT filepath, name FROM keyed WHERE error IS NULL AND request_id // 8 % 2 = 0"""),
    "asked_ids": ([], """
  SELECT c_custkey AS id FROM customer WHERE c_nationkey % 2 = 1"""),
    "flights": (["keyed"], """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY ts, request_id) AS nth,
      min(ts) OVER (PARTITION BY filepath) AS arrival,
      count(*) OVER (PARTITION BY filepath) AS waiters
    FROM keyed WHERE error IS NULL) WHERE nth = 1"""),
    "jobs": (["flights"], """
  SELECT filepath, request_id,
    CASE WHEN type IN ('image', 'document') THEN 'image'
      WHEN type IN ('video', 'audio') THEN 'video' END AS job_class,
    arrival < TIMESTAMP '2024-01-01 00:08:00' AS running, arrival, waiters
  FROM flights"""),
    # Missing renditions with a source, the route of each and its geometry.
    "routed": (["keyed", "media", "cached"], f"""
  SELECT *, CASE source_type || '2' || type
      WHEN 'image2image' THEN 'image2image' WHEN 'video2video' THEN 'video2video'
      WHEN 'video2image' THEN 'video2image' WHEN 'audio2audio' THEN 'audio2audio'
      WHEN 'audio2image' THEN 'audio2image' WHEN 'document2image' THEN 'document2image'
      WHEN 'document2document' THEN 'document2document' END AS converter,
    '/work/render/' || name AS work_dir
  FROM (
    SELECT k.*, m.mimetype, m.width AS src_w, m.height AS src_h, m.compression,
      {media_type("m.mimetype")} AS source_type,
      row_number() OVER (PARTITION BY k.filepath ORDER BY k.ts, k.request_id) AS nth,
      count(*) OVER (PARTITION BY k.filepath) AS waiters
    FROM keyed k JOIN media m ON m.path = k.filename WHERE k.error IS NULL)
  WHERE nth = 1 AND type <> '*' AND filepath NOT IN (SELECT filepath FROM cached)"""),
    "faces": ([], """
  SELECT vec_id AS face_id, vec_id, CASE WHEN vec_id % 10 = 0 THEN vec_id
      ELSE 1000000 + vec_id // 5 END AS image_id,
    CAST(CASE WHEN vec_id % 10 = 0 THEN 0 WHEN vec_id // 5 % 2 = 0 THEN vec_id % 5 - 1 ELSE vec_id % 5 END AS INTEGER) AS face_no,
    1021 AS img_w, 769 AS img_h,
    vec_id * 29 % 500 AS top, vec_id * 17 % 700 + 30 + vec_id % 91 AS "right",
    vec_id * 29 % 500 + 30 + vec_id % 83 AS bottom, vec_id * 17 % 700 AS "left",
    CAST(embedding AS DOUBLE[]) AS encoding, label AS person
  FROM embeddings"""),
    "images": (["faces"], """
  SELECT DISTINCT image_id FROM faces
  UNION ALL SELECT 2000000 + vec_id FROM embeddings WHERE vec_id % 7 = 0"""),
    "known": (["faces"], """
  SELECT 'person' || person AS name, encoding FROM faces WHERE image_id < 1000000"""),
    "unknown": (["faces"], """
  SELECT * FROM faces WHERE image_id >= 1000000"""),
    "matches": (["known", "unknown"], """
  SELECT face_id, image_id, name, distance FROM (
    SELECT u.face_id, u.image_id, k.name, list_distance(u.encoding, k.encoding) AS distance
    FROM unknown u CROSS JOIN known k) WHERE distance <= 1.1"""),
}


def with_views(body: str, *names: str) -> str:
    """The statement, preceded by the views it names and those they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for read in VIEWS[name][0]:
            add(read)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]}\n)" for name in ordered)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()
