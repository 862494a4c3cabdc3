"""Registered queries: tokens, embeddings, search, context."""

from pyspark.sql import functions as F

from corpusloom.functions.rows import explode_once
from corpusloom.operators import byte_tokens
from corpusloom.operators import files as file_ops
from corpusloom.operators import search as ops
from corpusloom.operators import tokens as tok
from corpusloom.operators import vectors as vec
from corpusloom.operators.byte_tokens import BytePairs
from corpusloom.plans.catalog_files import repo_blocks
from corpusloom.plans.derived import TOKEN_RE, with_views
from corpusloom.plans.registry import query, table
from corpusloom.session import scratch_path

_COUNT = f"len(regexp_extract_all(text, '{TOKEN_RE}'))"


@query(f"select doc_id, {_COUNT}::int as n_tokens from documents")
def n_tokens(spark, sf_dir):
    return tok.n_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


CHUNK = 256


@query(
    f"""with t as (select doc_id, regexp_extract_all(text, '{TOKEN_RE}') as toks from documents),
    c as (select doc_id, toks, unnest(range(0, len(toks), {CHUNK})) as i from t)
    select doc_id, (i // {CHUNK})::int as chunk, array_to_string(toks[i + 1 : i + {CHUNK}], ' ') as tokens,
    len(toks[i + 1 : i + {CHUNK}])::int as n_tokens from c"""
)
def token_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tok.token_chunks(docs, CHUNK).withColumn("tokens", F.array_join("tokens", " "))


def byte_pairs(spark):
    import public_tokenizers

    return BytePairs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()  # merges have no SQL; tests compare ids with the library's
def byte_pair_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_tokens.byte_pair_counts(docs, byte_pairs(spark)).select("doc_id", "n_tokens")


@query()  # merges have no SQL; tests compare ids with the library's
def byte_pair_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_tokens.byte_pair_chunks(docs, byte_pairs(spark), CHUNK)


@query(
    """with m as (select label, i as dim, sum((vec_id + 1) * embedding[i]::double) / sum(vec_id + 1) as x
    from embeddings, (select unnest(range(1, 65)) as i) r group by 1, 2),
    n as (select label, sqrt(sum(x * x)) as n from m group by 1)
    select label, dim::int as dim, round(x / n, 6) as value from m join n using (label)"""
)
def combine_chunk_embeddings(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").withColumn("n_tokens", F.col("vec_id") + 1)
    means = vec.combine_chunk_embeddings(chunks, ["label"])
    return means.select("label", F.posexplode("embedding").alias("pos", "x")).select(
        "label", (F.col("pos") + 1).alias("dim"), F.round("x", 6).alias("value")
    )


@query(
    f"""with t as (select doc_id, unnest(regexp_extract_all(text, '{TOKEN_RE}')) as t from documents),
    b as (select doc_id, (('0x' || substr(md5(t), 1, 6))::bigint % 64)::int as dim, count(*)::double as n from t group by 1, 2),
    s as (select doc_id, sqrt(sum(n * n)) as len from b group by 1)
    select doc_id, dim, round((n / len)::float::double, 4) as value from b join s using (doc_id)"""
)
def embed_documents(spark, sf_dir):
    docs = vec.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", out="embedding")
    return (
        explode_once(docs, ["doc_id"], F.col("embedding"), "dim", "x")
        .filter(F.col("x") != 0)
        .select("doc_id", "dim", F.round(F.col("x").cast("double"), 4).alias("value"))
    )


_ROLE = f"len(regexp_extract_all(role, '{TOKEN_RE}'))"
MESSAGE_COST = f"(3 + {_ROLE} + 2 + {_COUNT} + 2)"


@query(f"select conv_id, (sum({MESSAGE_COST}) + 3)::bigint as n_tokens from conversations group by 1")
def chat_tokens(spark, sf_dir):
    return tok.chat_tokens(table(spark, sf_dir, "conversations"))


@query(
    f"""with t as (select {_COUNT} as n from documents), l as (select min(n) as lo, max(n) as hi from t)
    select least(floor((n - lo) / ((hi - lo) / 10.0::double)), 9)::int as bin, count(*) as n, min(t.n)::int as low,
    max(t.n)::int as high from t, l group by 1"""
)
def token_histogram(spark, sf_dir):
    return tok.token_histogram(tok.n_tokens(table(spark, sf_dir, "documents")))


def _first_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == 0).first()["embedding"]


_SCORED = """with q as (select embedding::double[] as v from embeddings where vec_id = 0),
    s as (select vec_id, label, list_dot_product(embedding::double[], v) as s from embeddings, q)"""


@query(_SCORED + " select vec_id, label, round(s, 6) as similarities from s order by s desc, vec_id limit 3")
def semantic_search(spark, sf_dir):
    index = table(spark, sf_dir, "embeddings")
    hits = vec.semantic_search(index, _first_vector(spark, sf_dir), key="vec_id", vector="embedding")
    return hits.select("vec_id", "label", F.round("similarities", 6).alias("similarities"))


@query(
    """with s as (select a.vec_id as query_id, b.vec_id as vec_id,
      list_dot_product(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b),
    r as (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from s)
    select query_id, vec_id, round(s, 6) as similarities, rank::int as rank from r where rank <= 3"""
)
def semantic_search_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    hits = vec.semantic_search_batch(rows, queries, key="vec_id", vector="embedding")
    return hits.withColumn("similarities", F.round("similarities", 6))


@query(
    _SCORED
    + """ select 'doc/' || label || ':' || s.vec_id || '  distance=' || (round(s, 3)::varchar) as label,
    array_to_string((string_split(text, chr(10)))[1:7], chr(10)) as preview
    from s join documents d on d.doc_id = s.vec_id order by s desc, s.vec_id limit 3"""
)
def preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("code"))
    index = table(spark, sf_dir, "embeddings").join(docs, "vec_id")
    hits = vec.semantic_search(index, _first_vector(spark, sf_dir), key="vec_id", vector="embedding")
    named = hits.withColumn("filepath", F.concat(F.lit("doc/"), F.col("label").cast("string")))
    return file_ops.preview(named, key="vec_id").select("label", "preview")


@query(
    """with q as (select embedding::double[] as v from embeddings where vec_id = 0)
    select vec_id, round(1 - list_dot_product(embedding::double[], v)
      / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(v, v))), 6) + 0.0 as distances
    from embeddings, q"""
)
def rank_by_cosine(spark, sf_dir):
    ranked = vec.rank_by_cosine(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir))
    return ranked.select("vec_id", (F.round("distances", 6) + 0.0).alias("distances"))


def _part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("block_id"),
        F.col("p_type").alias("class_name"),
        F.col("p_name").alias("function_name"),
    )


@query(
    "select p_partkey as block_id, levenshtein(p_type || p_name, 'SMALLred bolts')::int as distance from part "
    "order by distance, block_id limit 3"
)
def find_function_match(spark, sf_dir):
    return ops.find_function_match(_part_names(spark, sf_dir), "red bolts", "SMALL").select("block_id", "distance")


@query(
    """with a as (select distinct c_mktsegment || ' ' || n_name as asked from customer join nation
        on c_nationkey = n_nationkey),
    d as (select asked, p_partkey as block_id, levenshtein(p_type || p_name, asked)::int as distance from a, part),
    r as (select *, row_number() over (partition by asked order by distance, block_id)::int as rank from d)
    select asked, block_id, distance, rank from r where rank <= 3"""
)
def find_function_match_batch(spark, sf_dir):
    customer, nation = (table(spark, sf_dir, t) for t in ("customer", "nation"))
    asked = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        F.concat("c_mktsegment", F.lit(" "), "n_name").alias("asked")
    )
    return ops.find_function_match_batch(_part_names(spark, sf_dir), asked)


def keyed_blocks(spark, sf_dir):
    key = F.concat("filepath", F.lit("#"), F.col("ordinal").cast("string"))
    return repo_blocks(spark, sf_dir).withColumn("block_id", key)


_NAMED = """, b as (select path || '#' || ordinal as block_id, coalesce(class_name, '') || coalesce(function_name, '') as name,
    code from code_blocks)"""


@query(
    with_views(
        _NAMED + " select code from b order by levenshtein(name, 'C_10x'), block_id limit 1", "code_blocks"
    )
)
def best_match_code(spark, sf_dir):
    return ops.best_match_code(keyed_blocks(spark, sf_dir), "10x", "C_")


@query(
    with_views(
        _NAMED
        + """, a as (select distinct 'm_' || p_size as asked from part),
        d as (select asked, code, row_number() over (partition by asked order by levenshtein(name, asked), block_id) as r
          from a, b)
        select asked, '[' || string_agg(to_json({'code': code})::varchar, ', ' order by r) || ']' as answer
        from d where r <= 3 group by 1""",
        "code_blocks",
    )
)
def view_function_code(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.concat(F.lit("m_"), F.col("p_size").cast("string")).alias("asked"))
    # read twice, by name and for the codes of the hits, as a stored index is
    index = scratch_path(spark, "named-blocks")
    keyed_blocks(spark, sf_dir).select("block_id", "class_name", "function_name", "code").write.parquet(index)
    return ops.view_function_code(spark.read.parquet(index), asked)


@query(
    """with s as (select a.vec_id as query_id, b.vec_id as vec_id,
      list_dot_product(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b
      where b.vec_id in (select doc_id from documents)),
    r as (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from s)
    select query_id, string_agg(text, chr(10) order by rank) as context
    from r join documents on doc_id = vec_id where rank <= 3 group by 1"""
)
def qa_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("code"))
    rows = table(spark, sf_dir, "embeddings")
    index = rows.join(docs.select("vec_id"), "vec_id", "left_semi")
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    hits = vec.semantic_search_batch(index, queries, key="vec_id", vector="embedding")
    return ops.qa_context(hits, docs, key="vec_id")


def ranked_documents(spark, sf_dir):
    """Documents ranked per source by a distance that stands in for a query's."""
    docs = tok.n_tokens(table(spark, sf_dir, "documents"))
    distance = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("long")
    return docs.select(F.col("source").alias("query_id"), "doc_id", "text", "n_tokens", distance.alias("distances"))


PACKED = f"""with d as (select source as query_id, doc_id, text, {_COUNT} as n_tokens,
      ('0x' || substr(md5(doc_id::varchar), 1, 6))::bigint as distances from documents),
    r as (select *, sum(n_tokens + 4) over (partition by query_id order by distances, doc_id) as cur_len from d),
    p as (select query_id, string_agg(text, chr(10) || chr(10) || '###' || chr(10) || chr(10) order by distances, doc_id)
      as context, count(*) as n_rows, max(cur_len)::bigint as cur_len from r where cur_len <= 1800 group by 1)"""


@query(PACKED + " select * from p")
def pack_context(spark, sf_dir):
    return ops.pack_context(ranked_documents(spark, sf_dir))
