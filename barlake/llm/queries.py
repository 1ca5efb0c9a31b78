"""The queries of this package, each over its whole table, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_topk, jaccard_join, katz_lm, license_scan, merkle, pii, quality_rules, source_mix, spelling, substring_dedup, suffix_dedup, url_filters
from .common import documents


#: Rank file of the byte-level BPE vocabulary; its place is a parameter of the operator.
VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard_join.join(documents(spark, sf_dir)).select("doc_id", "class_id", F.col("node").alias("same_text_id"), "n_copies", "n_links")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the personal data of every document."""
    found = pii.detect(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, "spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule columns and verdict of every document, by a model trained on the labelled ones."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, model).drop("text")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that another document has too."""
    return suffix_dedup.find(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages of 50 words and more that two documents share."""
    return substring_dedup.find(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to, as digests."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best other vectors of each vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return url_filters.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of the training ones."""
    return katz_lm.score(documents(spark, sf_dir))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = source_mix.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words' number, the frequent word that it stands for and where those lead."""
    return spelling.variants(spelling.count_words(documents(spark, sf_dir)))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proof of every document, and the root that a third of them, with their text lower-cased, would lead to."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    altered = F.when(tampered, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    found = merkle.audit(merkle.manifest(documents(spark, sf_dir), altered))
    told = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return found.select("doc_id", *told, "proof_sha256", F.lower(F.hex("folded_root")).alias("folded_root"), "verified")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_pii": op2_pii,
        "op3_quality_rules": op3_quality_rules,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_exact_topk": op7_exact_topk,
        "op8_url_filters": op8_url_filters,
        "op9_katz_lm": op9_katz_lm,
        "op10_source_mix": op10_source_mix,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_license_scan": op13_license_scan,
    }


TOPK_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
    select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as score
    from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as r from pairs
)
select query_id, cast(r as integer) as rank, vec_id, cast(score as bigint) as score from ranked where r <= 5
"""


#: The table of crc32, which DuckDB lacks.
CRC_TABLE = """
    select list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t
    from (select cast(range as bigint) as i from range(256))
"""

SPELLING_SQL = f"""
with tab as ({CRC_TABLE}), runs as (
    select coalesce(cast(doc_id as varchar), '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents)
    where length(run) >= 7 group by all
), bytes as (
    select run, n, length(run) as size, list_transform(range(octet_length(encode(s))), lambda i: cast('0x' || substr(hex(encode(s)), cast(2 * i + 1 as integer), 2) as bigint)) as b
    from (select *, id || ':' || run as s from runs)
), hashed as (
    select run, n, size, xor(4294967295, list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) as h from bytes, tab
), words as (
    select word, cast(sum(n) as bigint) as n
    from (select case when h % 31 = 0 then substr(run, 1, h % size) || substr(run, h % size + 2) else run end as word, n from hashed)
    where length(word) >= 7 group by word having sum(n) >= 2
), cut as (
    select word, n, i, substr(word, 1, i) || substr(word, i + 2) as part from (select word, n, unnest(range(length(word))) as i from words)
), near as (
    select a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.part = b.part and a.i = b.i and a.word <> b.word
    union select a.word, a.n, b.word, b.n from cut a join words b on a.part = b.word
    union select b.word, b.n, a.word, a.n from cut a join words b on a.part = b.word
), best as (
    select word, count(*) as n_near, arg_min(other, (-other_n, other)) as form, max(other_n) as form_n from near group by word
), forms as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * n then form end as form, case when form_n >= 10 * n then form_n end as form_n
    from words w left join best b on w.word = b.word
), led as (
    with recursive r as (select word, word as root, 0 as k from forms union all select r.word, f.form, k + 1 from r join forms f on f.word = r.root where f.form is not null)
    select word, arg_max(root, k) as root from r group by word
)
select forms.word, form, root, n, n_near, form_n from forms join led on forms.word = led.word
"""

#: Levels that the SQL builds: enough for 8 ** 8 rows.
_LEVELS = 8


def _levels(tree: str, first: str) -> str:
    """Common table expressions of a tree over first (g, i, n, d): nodes of each level, and for each run its digests in order."""
    out = []
    for k in range(_LEVELS):
        below = first if not k else f"{tree}{k}"
        out.append(f"{tree}_runs{k} as (select g, i // 8 as i, max(n) as n, list(d order by i) as ds from {below} group by g, i // 8)")
        out.append(f"{tree}{k + 1} as (select g, i, (n + 7) // 8 as n, case when n > 1 then sha256(array_to_string(ds, '')) else ds[1] end as d from {tree}_runs{k})")
    return ", ".join(out)


def _path(tree: str, rows: str, name: str) -> str:
    """rows (g, i, proof, folded, ...) with the siblings of a tree added to proof, and folded carried up to its root."""
    out = []
    for k in range(_LEVELS):
        below, p = rows if not k else f"{name}{k - 1}", f"(x.i // {8**k} % 8)"
        others = f"list_concat(ds[1:{p}], ds[{p} + 2:])"
        whole = f"array_to_string(ds[1:{p}], '') || folded || array_to_string(ds[{p} + 2:], '')"
        out.append(f"""{name}{k} as (select x.* replace (case when r.n > 1 then proof || array_to_string({others}, '') else proof end as proof, case when r.n > 1 then sha256({whole}) else folded end as folded)
            from {below} x join {tree}_runs{k} r on r.g = x.g and r.i = x.i // {8 ** (k + 1)})""")
    return ", ".join(out)


def _told(text: str) -> str:
    columns = ["cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


MERKLE_SQL = f"""
with tab as ({CRC_TABLE}), crc as (
    select doc_id, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) as h
    from (select distinct doc_id from documents), tab
), leaf as (
    select doc_id, lang, {_told("text")} as d, case when h % 3 = 0 then {_told("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_told("text")} end as folded
    from documents join crc using (doc_id)
), leaves as (
    select doc_id, coalesce('=' || lang, '') as g, row_number() over (partition by lang order by doc_id, d) - 1 as i, count(*) over (partition by lang) as n, d, folded, '' as proof from leaf
), {_levels("a", "leaves")}, tops as (
    select 0 as g, row_number() over (order by g) - 1 as i, count(*) over () as n, d, g as lang from a{_LEVELS}
), {_levels("b", "tops")}, {_path("a", "leaves", "p")}, joined as (
    select p.doc_id, p.d as leaf, t.d as subroot, proof, folded, 0 as g, t.i from p{_LEVELS - 1} p join tops t on t.lang = p.g
), {_path("b", "joined", "q")}
select doc_id, leaf, subroot, d as root, sha256(proof) as proof_sha256, folded as folded_root, folded = d as verified from q{_LEVELS - 1}, b{_LEVELS}
"""


def _license_sql() -> str:
    """The scan with grams compared as words, not as hashes."""
    told = [(True, *x) for x in license_scan.PHRASES] + [(False, *x) for x in license_scan.NOTICES]
    values = ", ".join(f"({i}, {base}, '{label}', '{text}')" for i, (base, label, text) in enumerate(told))

    def words(text: str) -> str:
        lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"list_filter(regexp_split_to_array({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

    return f"""
with t as (select *, len(own) as size, case when base then 2 else 3 end as k, not base and len(own) >= 20 as loose from (select i, base, label, {words("text")} as own from (values {values}) v(i, base, label, text))),
    d as (select row_number() over () as rid, doc_id, {words("text")} as words from documents),
    tg as (select i, k, p as tp, own[p + 1:p + k] as gram from t, lateral (select unnest(range(size - k + 1)) as p)),
    dg as (select rid, k, p, words[p + 1:p + k] as gram from d, (values (2), (3)) ks(k), lateral (select unnest(range(len(words) - k + 1)) as p)),
    v as (select rid, i, p - tp as g, list(distinct tp) as tp from dg join tg using (k, gram) group by all),
    h as (select v.*, size, k, loose from v join t using (i)),
    r as (select *, sum(case when before is null or g - before > 3 then 1 else 0 end) over (partition by rid, i order by g) as run
          from (select *, lag(g) over (partition by rid, i order by g) as before from h where loose)),
    m as (select rid, i, size, list(g order by g) as gs, len(list_distinct(flatten(list(tp)))) as n from r group by rid, i, size, run),
    s as (select rid, i, [g] as gs from h where not loose and len(tp) = size - k + 1
          union all select rid, i, gs from m where n >= greatest(size - 2 - 3 * floor(size * 0.2 + 1e-9), 1)),
    c as (select s.rid, i, gs, len(list_filter(range(size), lambda q: len(list_filter(gs, lambda g: q + g >= 0 and words[q + g + 1] = own[q + 1])) > 0)) / size::double as share from s join d using (rid) join t using (i)),
    f as (select rid, share, label, base and good as base_good, good, list_min(gs) as first from (select *, share >= case when loose then 0.8 else 1 end as good from c join t using (i))),
    x as (select rid, count(*) filter (where base_good) as n_base, min(first) filter (where base_good) as first_word, max(first) filter (where base_good) as last_word,
                 string_agg(distinct label, ',' order by label) filter (where base_good) as base_labels, string_agg(distinct label, ',' order by label) filter (where good) as labels, max(share) as score from f group by rid)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
from d left join x using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": TOPK_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_license_scan": _license_sql()}
