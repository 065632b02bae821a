"""The registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import chat, collocations, decontam, line_dedup, media, mixing, pii, sentence_dedup, sentencepiece, simhash, suffix_dedup, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a (spark, sf_dir) function, and its oracle if there is one."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op9_line_dedup",
    r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
    k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
    s as (select key, min(doc_id) as first_doc from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
    d as (select k.*, coalesce(k.doc_id > s.first_doc, false) as gone from k left join s using (key))
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
        sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
    from d group by doc_id""",
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("new_text", 256).alias("kept_sha256"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model).select("row.doc_id", "score")
    return out.select("doc_id", F.expr(toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op1_decontamination",
    r"""with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
    b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
    bw as (select item_id, least(len(w), 13) as n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') as k
        from (select *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as s from b where len(w) > 0)),
    lens as (select distinct n from bw),
    dw as (select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as k
        from (select *, unnest(range(1, greatest(len(w) - n, -1) + 2)) as s from d, lens where len(w) >= n)),
    hit as (select doc_id, s, dw.n as n, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
    cov as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from hit)) group by doc_id),
    it as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as l from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
    select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
        sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join cov on d.doc_id = cov.doc_id left join it on d.doc_id = it.doc_id""",
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.contamination(docs, read(spark, sf_dir, "benchmark"))
    items = F.col("items")
    return out.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)
    return out.select("row.doc_id", "n_tokens", "n_fallback", "ids_sha256", "decoded_sha256", "round_trip")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_sentence_dedup")
def op2_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), content_cuts=True, few_sentences=3)
    return out.select("row.doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_media")
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    out = media.read_media(stored)
    return out.select(
        "row.row.doc_id", "row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("fingerprint").cast("long").alias("n_pairs")
    )


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("row.doc_id", *map(number, ("email", "ip", "card", "phone")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


@query(
    "op3_chat_format",
    r"""with m as (select conv_id, turn, role, text from conversations),
    c as (select conv_id, concat(conv_id, ':', turn) as call_id, turn, text, count(*) as copies from m where role = 'user' group by all),
    f as (select conv_id, call_id, min(turn) as turn from c group by all),
    r as (select conv_id, concat(conv_id, ':', turn - 1) as call_id, turn, text, count(*) as copies from m where role = 'assistant' group by all),
    p as (select conv_id, turn, role, text, count(*) as copies from m where role is null or role not in ('user', 'assistant') group by all)
    select conv_id, turn, turn as rank, 'call' as kind, call_id,
        case when exists (select 1 from r where r.conv_id = c.conv_id and r.call_id = c.call_id) then 'linked' else 'unanswered' end as status,
        concat_ws(',', case when text is null then 'missing:text' end, case when length(text) > 20000 then 'maxLength:text' end, case when length(text) < 1 then 'minLength:text' end,
            case when turn < 0 then 'minimum:turn' end,
            case when turn >= 2 and not exists (select 1 from f where f.conv_id = c.conv_id and f.turn = c.turn - 2) then concat('dependency:', conv_id, ':', turn - 2) end) as errors,
        copies, cast(to_json({'arguments': {'conversation': conv_id, 'text': text, 'turn': turn}, 'id': call_id, 'name': 'reply', 'type': 'call'}) as varchar) as json from c
    union all select conv_id, turn, turn, 'result', call_id, case when exists (select 1 from f where f.conv_id = r.conv_id and f.call_id = r.call_id) then 'linked' else 'orphan' end, '', copies,
        cast(to_json({'content': text, 'id': call_id, 'type': 'result'}) as varchar) from r
    union all select conv_id, turn, turn, 'message', null, 'plain', '', copies, cast(to_json({'content': text, 'role': role, 'type': 'message'}) as varchar) from p""",
)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chat.turns_as_calls(read(spark, sf_dir, "conversations"))
    return chat.format_chats(*parts, chat.REPLY_SCHEMA)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained"))
    rows = out.select("row.vec_id", "n", "deviation", "identity_error", "residual", each.alias("k", "v"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "v.whitened", "v.explained", "identity_error", "residual")


@query(
    "op12_collocations",
    r"""with d as (select coalesce(lang, 'und') as lang, row_number() over () as i, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
    p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
    w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
    g as (select lang, m as size, unnest(list_transform(range(1, len(ws) - m + 2), lambda s: array_to_string(ws[s : s + m - 1], ' '))) as phrase from w, (values (1), (2), (3)) v(m) where len(ws) >= m),
    f as (select lang, size, phrase, count(*) as f from g group by all),
    n as (select lang, cast(sum(f) as bigint) as n from f where size = 1 group by lang),
    c as (select lang, size, phrase, f as a, string_split(phrase, ' ') as ws from f where size > 1 and f >= 10),
    k as (select *, unnest(range(1, size)) as k from c),
    s as (select k.lang, k.phrase, k.size, k.a, k.k, l.f as l, r.f as r, 1000000 * k.a::hugeint * k.a::hugeint // (l.f::hugeint * r.f::hugeint) as score from k
        join f l on l.lang = k.lang and l.phrase = array_to_string(ws[1 : k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(ws[k + 1 : k.size], ' ')),
    b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    i as (select lang, phrase, max(a) as longer from (select lang, a, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) as phrase from c where size = 3) group by all),
    x as (select b.* from b left join i using (lang, phrase) where coalesce(100 * longer < 50 * a, true))
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score
    from x join n using (lang) qualify rank <= 2000""",
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


@query("op13_mixing")
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))
