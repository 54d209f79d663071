"""The registered query of each operator, and its DuckDB SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed, fim, imatch, jaccard, lmscore, merkle, mix, quality, rules, secrets, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: chat formatting -------------------------------------------------------------------------
@query("op1_chat_format")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.render(chat.events_of_turns(turns.unionByName(more))))


# --- 2: quality rules ---------------------------------------------------------------------------
OP2_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select r, unnest(regexp_extract_all(t, '{WORD}')) as word, generate_subscripts(regexp_extract_all(t, '{WORD}'), 1) as i from d),
win as (select r, i, word, lead(word) over (partition by r order by i) as w2, lead(word, 2) over (partition by r order by i) as w3 from w),
twice as (select r, i from (select r, i, count(*) over (partition by r, word, w2, w3) as c from win where w3 is not null) where c > 1),
rep as (select r, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by r),
ln as (select r, unnest(string_split(t, chr(10))) as line from d),
lines as (select r, count(*) as n, count(*) - count(distinct line) as dup from ln where regexp_matches(line, '{WORD}') group by r),
m as (
  select d.doc_id,
    len(regexp_extract_all(t, '{WORD}')) as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(lines.n, 0) as n_lines, coalesce(lines.dup, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
  from d left join rep using (r) left join lines using (r)),
f as (select *, (n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (10 * n_symbols > n_words)::int
    + 8 * (word_chars < 2 * n_words)::int + 16 * (word_chars > 25 * n_words)::int
    + 32 * (n_dup_lines > 3 and 100 * n_dup_lines > 60 * n_lines)::int as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed,
  fail_bits = 0 as kept, fail_bits::bigint as fail_bits, '2' as policy from f
"""


@query("op2_quality_rules", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.ledger(table(spark, sf_dir, "documents"))
    led = rules.apply_policy(led, rules.BASE, out="base_kept")
    led = rules.apply_policy(led, rules.POLICY)
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits", F.lit(rules.POLICY.version).alias("policy"),
    )


# --- 3: mixing ----------------------------------------------------------------------------------
OP3_SQL = rf"""
with q as (select doc_id, case when max(coalesce(quality, 0)) > 0 then 2.0::double else 0.5::double end as weight from labels where doc_id is not null group by doc_id),
d as (
  select documents.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size, text,
    -ln((('0x' || substr(md5('42|' || documents.doc_id), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / coalesce(weight, 1.0) as key
  from documents left join q on documents.doc_id = q.doc_id),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as w, source_size * 2.0::double as cap from s),
l as (select *, ((sum(source_size) over ())::bigint * 1.5::double - coalesce(sum(cap) over (order by cap / w, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(w) over (order by cap / w, source is null, encode(source) rows between current row and unbounded following) as level from n),
t as (select source, source_size, case when cap <= level * w then cap
    else (max(case when cap > level * w then level end) over ()) * w end as target from l),
g as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as copies from t),
p as (
  select d.doc_id, size, source_size, target, copies, floor(target + 0.5)::bigint - copies * source_size as rest,
    sum(size) over (partition by d.source order by key, d.doc_id, text rows between unbounded preceding and current row)::bigint as upto, d.source
  from d join g on d.source is not distinct from g.source),
b as (select *, rest - coalesce(max(case when upto <= rest then upto end) over (partition by source), 0) as gap from p),
r as (select *, row_number() over (partition by source order by upto <= rest or size = 0, abs(size - gap), upto) = 1 and upto > rest and abs(size - gap) < gap as picked from b)
select doc_id, size, source_size, target, (copies + (size > 0 and (upto <= rest or picked))::int) * size as taken, copies from r
"""


@query("op3_mix_sources", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mix.label_weights(table(spark, sf_dir, "labels"))
    got = mix.sample(table(spark, sf_dir, "documents"), weights)
    return got.select("doc_id", "size", "source_size", "target", "taken", "copies")


# --- 6: secrets ---------------------------------------------------------------------------------
@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.text_of_spans(base), 256).alias("base_sha256"), secrets.text_of_spans(F.col("spans")).alias("spans"),
        count(3).alias("n_entropy"),
    )


# --- 9: URL filter ------------------------------------------------------------------------------
@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages.select("page_id", "url"), urls.link_edges(pages))


# --- 4: byte-level BPE --------------------------------------------------------------------------
@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, P.PATTERN)
    back = bpe.decode(ids.select("doc_id", "ids"), path)
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# --- 5: quality classifier ----------------------------------------------------------------------
@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --- 7: embedding near-duplicates ---------------------------------------------------------------
@query("op7_embedding_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# --- 8: n-gram Jaccard join ---------------------------------------------------------------------
@query("op8_ngram_jaccard")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, percent=90))


# --- 10: language-model scoring -----------------------------------------------------------------
@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lmscore.score(table(spark, sf_dir, "documents"), good)


# --- 11: fingerprints ---------------------------------------------------------------------------
@query("op11_fingerprint")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = imatch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id", "n_chars", "edited_sha256", imatch.as_text(F.col("own")).alias("fingerprint"),
        imatch.as_text(F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


# --- 12: fill-in-middle -------------------------------------------------------------------------
OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as ln,
    sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (select *, len(ln) as n, [('0x' || substr(h, 1, 8))::bigint, ('0x' || substr(h, 9, 8))::bigint, ('0x' || substr(h, 17, 8))::bigint, ('0x' || substr(h, 25, 8))::bigint] as x from d),
c as (select *, least(x[1] % (n + 1), x[2] % (n + 1)) as a, greatest(x[1] % (n + 1), x[2] % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or x[3] % 100 >= 100 then 'plain'
      when x[4] % 100 < 50 then 'spm' else 'psm' end as form from k),
p as (select *, coalesce(array_to_string(ln[1:a], ''), '') as pre, coalesce(array_to_string(ln[a + 1:b], ''), '') as mid, coalesce(array_to_string(ln[b + 1:n], ''), '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else t end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


# --- 13: Merkle manifest ------------------------------------------------------------------------
_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
OP13_SQL = f"""
with recursive crc as (  -- reflected CRC-32 of the id's digits: an exclusive or for each digit, then eight shifts
  select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_prepend(ord(c)::bigint, [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295::bigint) % 7 = 0 as hit
  from (select distinct doc_id from documents where doc_id is not null)),
leafs as (select d.doc_id, coalesce('=' || lang, '') as tree, {_LEAF.format(n="n_chars")} as leaf,
    {_LEAF.format(n="(case when hit then n_chars + 1 else n_chars end)")} as told from documents d left join crc using (doc_id)),
ranked as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, told) - 1 as r, count(*) over (partition by tree) as n from leafs),
nodes(tree, level, i, d) as (
  select tree, 0, r, leaf from ranked
  union all
  select tree, level + 1, i // 2, sha256(string_agg(d, '' order by i)) from (select *, count(*) over (partition by tree) as c from nodes) where c > 1 group by tree, level, i // 2),
height as (select tree, max(level) as h from nodes group by tree),
subs as (select tree, d, row_number() over (order by encode(tree)) - 1 as r from nodes join height using (tree) where level = h),
tops(level, i, d) as (
  select 0, r, d from subs
  union all
  select level + 1, i // 2, sha256(string_agg(d, '' order by i)) from (select *, count(*) over () as c from tops) where c > 1 group by level, i // 2),
crown as (select max(level) as h from tops),
steps as (
  select tree, r, 0 as part, l.level, case when s.d is null then 'N' when s.i < r >> l.level then 'L' || s.d else 'R' || s.d end as s
    from ranked join height using (tree), lateral (select unnest(range(h)) as level) l left join nodes s on s.tree = ranked.tree and s.level = l.level and s.i = xor(r >> l.level, 1)
  union all
  select ranked.tree, ranked.r, 1, l.level, case when s.d is null then 'N' when s.i < subs.r >> l.level then 'L' || s.d else 'R' || s.d end
    from ranked join subs on subs.tree = ranked.tree, crown, lateral (select unnest(range(crown.h)) as level) l left join tops s on s.level = l.level and s.i = xor(subs.r >> l.level, 1)),
proofs as (select tree, r, list(s order by part, level) as p, coalesce(string_agg(substr(s, 2), '' order by part, level), '') as said from steps group by tree, r),
folded as (select doc_id, leaf, subs.d as subroot, (select d from tops, crown where level = h) as root, sha256(coalesce(said, '')) as proof_sha256,
    list_reduce(list_prepend(told, coalesce(p, [])), lambda a, x: sha256(case x[1] when 'L' then substr(x, 2) || a when 'R' then a || substr(x, 2) else a end)) as folded_root
  from ranked join subs on subs.tree = ranked.tree left join proofs on proofs.tree = ranked.tree and proofs.r = ranked.r)
select *, folded_root = root as verified from folded
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda n: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    told = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaves = docs.select("doc_id", "lang", fields(F.col("n_chars")).alias("leaf"), fields(told).alias("told"))
    done = merkle.manifest(leaves).withColumn("folded_root", merkle.fold(F.col("told"), F.col("proof")))
    return done.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
