"""Image datasets derived from the page table: url as path, sizes from the page id."""

from trainset.operators import images as M
from trainset.queries.common import WS, F, long, query, table
from trainset.sources.images import read_image_table

_IMG = f"""WITH t AS (SELECT page_id, 'images/' || page_id || '.png' AS image, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), {WS}) AS caption,
  CAST(256 + (page_id * 37) % 1500 AS INTEGER) AS width, CAST(256 + (page_id * 61) % 1300 AS INTEGER) AS height, url FROM pages),
i AS (SELECT page_id, image, CASE WHEN page_id % 5 = 0 THEN '' ELSE caption END AS caption, width, height, url, 1 + page_id % 3 AS repeat FROM t) """


def images(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    from trainset.functions.text import strip

    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("images/"), p.cast("string"), F.lit(".png")).alias("image"),
        F.when(F.pmod(p, F.lit(5)) == 0, F.lit("")).otherwise(strip(title)).alias("caption"),
        (F.lit(256) + F.pmod(p * 37, F.lit(1500))).cast("int").alias("width"), (F.lit(256) + F.pmod(p * 61, F.lit(1300))).cast("int").alias("height"),
        "url", (F.lit(1) + F.pmod(p, F.lit(3))).cast("int").alias("repeat"),
    )


@query(
    "image_report",
    _IMG + """, s AS (SELECT *, least(width, height) AS short, width / height AS ratio FROM i), c AS (SELECT count(*) AS images,
    count(*) FILTER (short < 512) AS small_images, count(*) FILTER (caption = '') AS uncaptioned, count(*) FILTER (ratio BETWEEN 0.9 AND 1.1) AS square,
    count(*) FILTER (ratio > 1.1) AS landscape, count(*) FILTER (ratio < 0.9) AS portrait FROM s)
    SELECT *, (SELECT short FROM (SELECT short, row_number() OVER (ORDER BY short) - 1 AS rk FROM s) WHERE rk = (SELECT count(*) // 2 FROM s)) AS short_side_median,
      concat_ws('; ', CASE WHEN images < 10 THEN 'fewer than 10 images' END, CASE WHEN small_images > 0 THEN small_images || ' image(s) below 512px on the short side' END,
      CASE WHEN uncaptioned > 0 THEN uncaptioned || ' image(s) without a caption' END) AS tips FROM c""",
)
def image_report(spark, sf_dir):
    return M.image_report(images(spark, sf_dir))


@query(
    "image_table_import",
    """WITH h AS (SELECT page_id, sha1(html) AS d, length(html) = 0 AS none FROM pages)
    SELECT page_id AS seq, CASE WHEN none THEN 'no_image' ELSE 'unreadable' END AS reason FROM h""",
)
def image_table_import(spark, sf_dir):
    """Page bytes are no images: every row must be reported, none may stop the job."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.encode("html", "UTF-8").alias("content"))
    out = M.image_records(read_image_table(rows, "content"), "pages")
    return out.select(F.col("path").cast("long").alias("seq"), "reason")


@query("image_content_dedupe", "SELECT CASE WHEN rk > 1 THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY sha1(lang) ORDER BY doc_id) AS rk FROM documents) GROUP BY 1")
def image_content_dedupe(spark, sf_dir):
    """A PNG header per document, its size and content set by the language: equal bytes are copies."""
    def be(n):
        return F.to_binary(F.lpad(F.hex(n), 8, "0"), F.lit("hex"))

    head = F.to_binary(F.lit("89504E470D0A1A0A0000000D49484452"), F.lit("hex"))
    size = F.lit(600) + F.length("lang")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, be(size), be(size), F.encode("lang", "UTF-8")).alias("content"))
    out = M.image_records(read_image_table(rows, "content", key="doc_id").withColumn("path", F.lpad("path", 12, "0")), "documents")
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("caption_sidecars", _IMG + "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'a photo' END AS caption FROM i")
def caption_sidecars(spark, sf_dir):
    base = images(spark, sf_dir)
    files = base.withColumn("path", F.concat(F.lit("set/"), F.col("page_id").cast("string"), F.lit(".png"))).drop("caption")
    texts = base.where(F.pmod("page_id", F.lit(2)) == 0).select(
        F.concat(F.lit("set/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit(" "), F.col("url"), F.lit("\n")).alias("text")
    )
    return M.join_captions(files, texts, "a photo").select("page_id", "caption")


@query(
    "trigger_words",
    _IMG + "SELECT page_id, CASE WHEN contains(lower(caption), 'the') THEN caption WHEN caption = '' THEN 'The' ELSE 'The, ' || caption END AS caption FROM i",
)
def trigger_words(spark, sf_dir):
    return images(spark, sf_dir).select("page_id", M.apply_trigger(F.col("caption"), " The ").alias("caption"))


_B = ", ".join(f"({i}, '{h}x{w}', {w / h!r})" for i, (h, w) in enumerate(M.buckets_for(1024)))


@query(
    "aspect_buckets",
    _IMG + f"SELECT page_id, arg_min(b, (abs(ln(r / (width / height))), k)) AS bucket FROM i, (VALUES {_B}) AS v(k, b, r) GROUP BY page_id",
)
def aspect_buckets(spark, sf_dir):
    return images(spark, sf_dir).select("page_id", M.assign_bucket(F.col("height"), F.col("width"), M.buckets_for(1024)).alias("bucket"))


def _items(spark, sf_dir):
    records = images(spark, sf_dir).withColumn("captions", F.array("caption", F.lit(""), "url"))
    files = images(spark, sf_dir).where(F.pmod("page_id", F.lit(7)) != 3).select("image")
    return M.image_items(records, files)


@query("image_items", _IMG + "SELECT image, CAST(repeat AS BIGINT) AS copies, CASE WHEN caption = '' THEN 1 ELSE 2 END AS variants FROM i WHERE page_id % 7 <> 3")
def image_items(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("image").agg(F.count(F.lit(1)).alias("copies"), F.max(long(F.size("captions"))).alias("variants"))


@query("distinct_captions", _IMG + "SELECT count(*) AS captions FROM (SELECT caption FROM i WHERE page_id % 7 <> 3 AND caption <> '' UNION SELECT url FROM i WHERE page_id % 7 <> 3)")
def distinct_captions(spark, sf_dir):
    return M.distinct_captions(_items(spark, sf_dir)).agg(F.count(F.lit(1)).alias("captions"))


@query("set_captions", _IMG + "SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'new ' || page_id ELSE caption END AS caption FROM i")
def set_captions(spark, sf_dir):
    base = images(spark, sf_dir)
    new = base.where(F.pmod("page_id", F.lit(4)) == 1).select("image", F.concat(F.lit(" new "), F.col("page_id").cast("string")).alias("caption"))
    return M.set_captions(base, new).select("page_id", "caption")


@query("caption_images", _IMG + "SELECT page_id, CASE WHEN caption = '' THEN upper(image) ELSE caption END AS caption FROM i")
def caption_images(spark, sf_dir):
    out = M.caption_images(images(spark, sf_dir), F.col("image"), lambda ps: [' "' + p.split("\n", 1)[1].upper() + '" ' for p in ps])
    return out.select("page_id", "caption")


@query(
    "mix_image_sets",
    _IMG + "SELECT set_name AS dataset, 'images/' || set_name || '-' || page_id || '.png' AS image, count(*) AS copies FROM (SELECT *, CASE WHEN width > height THEN 'wide' ELSE 'tall' END AS set_name, unnest(range(2)) FROM i) GROUP BY 1, 2",
)
def mix_image_sets(spark, sf_dir):
    named = images(spark, sf_dir).withColumn("dataset", F.when(F.col("width") > F.col("height"), F.lit("wide")).otherwise(F.lit("tall")))
    return M.mix_images(named, 2).groupBy("dataset", "image").agg(F.count(F.lit(1)).alias("copies"))
