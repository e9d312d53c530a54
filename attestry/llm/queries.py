"""The registered queries of the numbered operators, and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from attestry.llm import (
    audit,
    bitslice,
    decontaminate,
    hmm,
    language,
    mixing,
    neardup,
    packing,
    secrets,
    shard,
    spelling,
    toxicity,
    warc,
)
from attestry.llm.storage import bounded_batches, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            bounded_batches(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql.strip()
        return run

    return register


@query("op1_near_duplicates", """
with recursive docs as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 1], ' ') shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) n from shingles group by 1),
common as (
  select a.doc_id one, b.doc_id two, count(*) overlap from shingles a join shingles b using (shingle)
  where a.doc_id < b.doc_id group by 1, 2),
links as (
  select one, two from common join sizes s on s.doc_id = one join sizes t on t.doc_id = two
  where 100 * overlap >= 80 * (s.n + t.n - overlap)),
edges as (select one, two from links union select two, one from links),
reach as (
  select doc_id, doc_id least_id from docs
  union
  select e.one, r.least_id from reach r join edges e on e.two = r.doc_id),
components as (select doc_id, min(least_id) component_id from reach group by 1)
select d.doc_id, coalesce(s.n, 0) n_shingles, component_id, d.doc_id = component_id kept
from docs d join components using (doc_id) left join sizes s on s.doc_id = d.doc_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op2_language_model")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return hmm.score_documents(documents.withColumn("held_out", language.held_out("doc_id", 7, 2)))


@query("op3_decontaminate", """
with words as (
  select doc_id, unnest(w) word, generate_subscripts(w, 1) pos from (
    select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
    from documents)),
item_words as (
  select item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
patterns as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') pattern
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from item_words where len(w) > 0)),
lengths as (select distinct n from patterns),
runs as (
  select doc_id, pos, n, string_agg(word, ' ') over (
    partition by doc_id, n order by pos rows between current row and (n - 1) following) run
  from words cross join lengths),
found as (select r.doc_id, r.pos, p.n, p.item_id from runs r join patterns p on r.run = p.pattern and r.n = p.n),
hit as (select doc_id, count(*) n_hit from (
  select distinct doc_id, unnest(range(pos, pos + n)) pos from found) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) listed from (
  select distinct doc_id, cast(item_id as varchar) item from found) group by 1),
sizes as (select doc_id, count(*) n_words from words group by 1)
select d.doc_id, coalesce(s.n_words, 0) n_words, cast(coalesce(h.n_hit, 0) as bigint) n_hit,
  coalesce(i.n_items, 0) n_items, sha256(coalesce(i.listed, '')) items_sha256, coalesce(h.n_hit, 0) > 0 contaminated
from documents d left join sizes s using (doc_id) left join hit h using (doc_id) left join items i using (doc_id)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op4_top_k", """
with vectors as (
  select row_number() over () row_id, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) v
  from embeddings
  where embedding is not null and vec_id is not null
    and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
parts as (
  select row_id, vec_id, unnest(v) x, generate_subscripts(v, 1) i from vectors),
scores as (
  select q.vec_id query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) score
  from parts q join parts c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 100 = 0
  group by q.row_id, c.row_id, q.vec_id, c.vec_id)
select * from (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank, vec_id, score
  from scores) where rank <= 10
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bitslice.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = language.held_out("doc_id", 4, 2)
    labelled = language.label_texts(documents, language.train_languages(documents.where(~held)))
    return labelled.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "weak")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.joined_text(base), 256).alias("base_sha256"),
        secrets.joined_text(F.col("spans")).alias("spans"),
    )


@query("op7_mix", """
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
    md5('17:' || coalesce(cast(doc_id as varchar), '')) place
  from documents),
sizes as (
  select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) source_no
  from docs group by source),
limited as (
  select *, [5.0, 2.0, 1.0][(source_no - 1) % 3 + 1]::double weight, 3 * source_size most from sizes),
levels as (
  select *, most / weight ratio,
    (sum(source_size) over () - coalesce(sum(most) over (
      order by most / weight, source_no rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by most / weight, source_no rows between current row and unbounded following) level
  from limited),
sources as (
  select *, least(most::double, weight * (
    select arg_min(level, (ratio, source_no)) from levels where level <= ratio)) target from levels),
queued as (
  select doc_id, size, source_no, source_size, weight, target, place,
    sum(size) over (partition by source_no order by place, size rows between unbounded preceding and current row)
      run
  from docs d join sources s on d.source is not distinct from s.source),
turns as (
  select *, unnest([0, 1, 2]) turn from queued where size > 0),
ended as (
  select *, sum(size) over (
    order by (turn * source_size + run)::double / weight, source_no, turn, place
    rows between unbounded preceding and current row) spent
  from turns),
taken as (
  select doc_id, sum(size) taken from ended where spent <= (select sum(size) from docs) group by 1)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) taken
from queued left join taken using (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("text_key")


@query("op8_warc", """
with pages as (
  select page_id, coalesce(html, '') payload from pages),
raw as (
  select page_id, strlen(payload) payload_bytes, sha1(payload) digest,
    min(page_id) over (partition by payload) original from pages),
bits as (
  select *, [('0x' || substr(digest, 1 + 5 * i, 5))::bigint for i in range(8)] groups from raw)
select page_id, payload_bytes,
  list_reduce([list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g >> s) & 31)::int, 1)
    for s in [15, 10, 5, 0]], lambda a, b: a || b) for g in groups], lambda a, b: a || b) payload_digest,
  case when page_id = original then 'response' else 'revisit' end record_type,
  case when page_id <> original then original end refers_to
from bits
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    fields = F.map_from_entries("metadata.fields")
    refers = F.regexp_extract("response.refers_to", r":(-?[0-9]+)>$", 1).cast("long")
    return captures.select(
        F.when(fields["page"] != "", fields["page"]).cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", fields["fetchedBytes"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", refers).alias("refers_to"),
    )


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = language.held_out("doc_id", 3, 1)
    model = toxicity.train_classifier(documents.where(~held), table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score_texts(documents, model)
    return scored.select("doc_id", held.alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted"))


@query("op10_shard")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query("op11_filter_audit", """
with texts as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
marked as (
  select doc_id, part,
    (len(w) < 200)::int
    + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int flags
  from texts),
known as (
  select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
flagged as (
  select part, flags, coalesce(good, false) good, coalesce(toxic, false) toxic from marked left join known using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) l),
orders as (
  select a.l || b.l || c.l || d.l || e.l filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (
  select filter_order, step,
    1 << (ascii(substr(filter_order, step, 1)) - 65) own,
    list_sum(list_transform(range(1, 6), lambda i: case when i < step then 1 << (ascii(substr(filter_order, i, 1)) - 65) else 0 end)) earlier
  from orders, (select unnest([1, 2, 3, 4, 5]) step)),
counts as (select part, flags, good, toxic, count(*) n from flagged group by all),
found as (
  select part, filter_order, cast(step as int) step, own,
    cast(coalesce(sum(n) filter (flags & (earlier | own) = 0), 0) as bigint) kept,
    cast(coalesce(sum(n) filter (flags & earlier = 0 and flags & own <> 0), 0) as bigint) removed,
    cast(coalesce(sum(n) filter (flags & earlier <> 0 and flags & own <> 0), 0) as bigint) redundant,
    cast(coalesce(sum(n) filter (flags = own), 0) as bigint) unique_fails,
    cast(coalesce(sum(n) filter (flags & earlier = 0 and flags & own <> 0 and good), 0) as bigint) good_lost,
    cast(coalesce(sum(n) filter (flags & earlier = 0 and flags & own <> 0 and toxic), 0) as bigint) toxic_lost
  from counts, steps group by part, filter_order, step, own)
select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) shapley from found
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer, capacity=2048)


@query("op13_spelling", """
with recursive crc_table as (
  select list_transform(range(256), lambda b: list_reduce(
    list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc),
runs as (
  select doc_id, run, count(*) occurrences from (
    select doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-zÀ-ÿ]+')) run
    from documents)
  group by all),
digits as (
  select *, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) h from runs),
hashed as (
  select run, occurrences, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8))) h
  from digits, crc_table),
results as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end word,
    occurrences from hashed),
words as (
  select word, cast(sum(occurrences) as bigint) n from results where length(word) >= 5
  group by word having sum(occurrences) >= 3),
places as (
  select word, n, i, substr(word, 1, i) || ' ' || substr(word, i + 2) gap, substr(word, 1, i) || substr(word, i + 2) less
  from (select word, n, unnest(range(length(word))) i from words)),
near as (
  select a.word, a.n, b.word near, b.n near_n from places a join places b using (i, gap) where a.word <> b.word
  union
  select p.word, p.n, w.word, w.n from places p join words w on w.word = p.less
  union
  select w.word, w.n, p.word, p.n from places p join words w on w.word = p.less),
best as (
  select word, count(*) n_near, arg_min(near, (-near_n, near)) near, max(near_n) near_n from near group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) n_near, case when near_n >= 2 * w.n then near end form,
    case when near_n >= 2 * w.n then near_n end form_n
  from words w left join best b on b.word = w.word),
ways as (
  select word, word last, form next from formed
  union all
  select y.word, f.word, f.form from ways y join formed f on f.word = y.next)
select f.word, form, last root, n, n_near, form_n from formed f join ways y on y.word = f.word and y.next is null
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
