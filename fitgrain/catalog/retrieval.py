"""Document chunking and nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fitgrain.catalog.registry import query, rounded, table, with_apps
from fitgrain.operators import retrieve as rt
from fitgrain.operators.cells import fit_cells
from fitgrain.plans.scoring import with_decision, with_rule_score
from fitgrain.session import scratch_path, spread, written
from fitgrain.sources.applications import applications

# The characters Python's str.split() separates on, for DuckDB's expressions.
BLANK_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
CHUNKS_SQL = f"""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS chunk_index,
      array_to_string(words[start + 1 : start + 300], ' ') AS chunk
    FROM (SELECT doc_id, words, unnest(generate_series(0, len(words) - 1, 250)) AS start FROM
      (SELECT doc_id, list_filter(string_split_regex(text, '{BLANK_CLASS}'), lambda w: w <> '') AS words FROM documents))
"""


def document_chunks(spark, sf_dir):
    return rt.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("r1_word_chunks", CHUNKS_SQL)
def r1(spark, sf_dir):
    return document_chunks(spark, sf_dir)


@query("r2_chunk_ids", f"SELECT doc_id || '_' || chunk_index AS chunk_id, chunk FROM ({CHUNKS_SQL})")
def r2(spark, sf_dir):
    return rt.with_chunk_id(document_chunks(spark, sf_dir), F.col("doc_id")).select("chunk_id", "chunk")


def chunk_store(spark, sf_dir):
    """Chunks with ids and vectors, and the encoder that made them."""
    docs = spread(table(spark, sf_dir, "documents"))
    chunks = written(rt.with_chunk_id(rt.chunked(docs, "doc_id", "text"), F.col("doc_id")), "chunks")
    encoder = rt.fit_encoder(chunks, "chunk")
    return written(encoder.encode(chunks, "chunk").select("chunk_id", "chunk", "embedding"), "store"), encoder


@query("r3_text_embedding", f"SELECT doc_id || '_' || chunk_index AS chunk_id, CAST({rt.DIMENSIONS} AS INT) AS width, 1.0E0 AS norm FROM ({CHUNKS_SQL})")
def r3(spark, sf_dir):
    store, _ = chunk_store(spark, sf_dir)
    return store.select("chunk_id", F.size("embedding").alias("width"), F.round(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)"), 4).alias("norm"))


@query("r3_word_vectors", f"SELECT doc_id || '_' || chunk_index AS chunk_id, CAST({rt.WORD_DIMENSIONS} AS INT) AS width, true AS unit_or_zero FROM ({CHUNKS_SQL})")
def r3_words(spark, sf_dir):
    """Chunks by learned word vectors, with an encoder that was saved and loaded."""
    docs = spread(table(spark, sf_dir, "documents"))
    chunks = written(rt.with_chunk_id(rt.chunked(docs, "doc_id", "text"), F.col("doc_id")), "chunks")
    path = scratch_path(spark, "encoder")
    rt.fit_word_vectors(chunks, "chunk").save(path)
    norm = F.round(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)"), 4)
    return rt.TextEncoder.load(path).encode(chunks, "chunk").select("chunk_id", F.size("embedding").alias("width"), norm.isin(0.0, 1.0).alias("unit_or_zero"))


DECIDED = (
    "decided",
    "SELECT ID, CASE WHEN applicant_income > loan_amount * 0.2E0 THEN 'approved' ELSE 'denied' END AS decision, loan_type, "
    "CAST(round(applicant_income) AS BIGINT) AS applicant_income, CAST(round(loan_amount) AS BIGINT) AS loan_amount FROM apps",
)


def decided(spark, sf_dir, dealt=False):
    """Applications with the baseline rule's decision and whole amounts."""
    scored = with_decision(with_rule_score(applications(spark, sf_dir, dealt)))
    return scored.select(
        "ID",
        "decision",
        "loan_type",
        F.round("applicant_income").cast("long").alias("applicant_income"),
        F.round("loan_amount").cast("long").alias("loan_amount"),
    )


@query(
    "r4_query_text",
    with_apps(
        "SELECT ID, 'Loan ' || decision || '. Loan type code: ' || coalesce(loan_type::VARCHAR, 'unknown') || '. Applicant income: $' || "
        "coalesce(applicant_income::VARCHAR, 'unknown') || '. Loan amount: $' || coalesce(loan_amount::VARCHAR, 'unknown') || '.' AS query FROM decided",
        DECIDED,
    ),
)
def r4(spark, sf_dir):
    text = rt.query_text(F.col("decision"), F.col("loan_type"), F.col("applicant_income"), F.col("loan_amount"))
    return decided(spark, sf_dir).select("ID", text.alias("query"))


def nearest_sql(queries: str, k: int, score: str, extra: str = "") -> str:
    return (
        "SELECT query_id, vec_id, CAST(place AS INT) AS place, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY score DESC, vec_id) AS place FROM (SELECT q.query_id, e.vec_id, round({score}, 9) AS score FROM {queries} q, "
        f"(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e {extra})) WHERE place <= {k}"
    )


CENTROIDS = (
    "(SELECT label AS query_id, list(m ORDER BY i) AS v FROM (SELECT label, i, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS m FROM "
    "(SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
)
ALL_VECTORS = "(SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("r5_nearest_to_centroids", nearest_sql(CENTROIDS, 3, "list_cosine_similarity(q.v, e.v)"))
def r5(spark, sf_dir):
    """The three stored vectors nearest to the mean vector of each label."""
    store = table(spark, sf_dir, "embeddings")
    parts = store.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("m"))
    # One entry per dimension.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"])
    centroids = means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("embedding"))
    return rounded(rt.top_k(centroids, store, 3, "cosine", store_id="vec_id"))


def _self_search(name: str, metric: str, k: int, score: str, **options) -> None:
    @query(name, nearest_sql(ALL_VECTORS, k, score))
    def run(spark, sf_dir):
        store = table(spark, sf_dir, "embeddings")
        return rounded(rt.top_k(store.withColumnRenamed("vec_id", "query_id"), store, k, metric, store_id="vec_id", **options))


_self_search("r6_top_k_l2", "l2", 5, "-list_distance(q.v, e.v)")
_self_search("r6_top_k_dot", "dot", 5, "list_dot_product(q.v, e.v)")
# The same search over cells of the store, as for sides that outgrow the driver.
_self_search("r6_top_k_blocks", "l2", 5, "-list_distance(q.v, e.v)", side_floats=64 * 200)


@query("r6_cosine_cells", nearest_sql(ALL_VECTORS, 5, "list_cosine_similarity(q.v, e.v)"))
def r6_cells(spark, sf_dir):
    """All pairs of vectors by cosine over cells of the store; bounds rule out the others."""
    store = table(spark, sf_dir, "embeddings")
    return rounded(rt.top_k(store.withColumnRenamed("vec_id", "query_id"), store, 5, "cosine", store_id="vec_id", side_floats=64 * 100))


@query("r6_dot_cells", nearest_sql(ALL_VECTORS, 5, "list_dot_product(q.v, e.v)"))
def r6_dot_cells(spark, sf_dir):
    """The same by inner product, over cells of the lifted store."""
    store = table(spark, sf_dir, "embeddings")
    return rounded(rt.top_k(store.withColumnRenamed("vec_id", "query_id"), store, 5, "dot", store_id="vec_id", side_floats=64 * 100))


@query("r6_cells_compared", with_apps("SELECT count(*) AS n_queries, count(*) * count(*) AS all_pairs, true AS most_skipped FROM apps WHERE loan_amount IS NOT NULL AND applicant_income IS NOT NULL"))
def r6_compared(spark, sf_dir):
    """Applications near in amount and income: of all pairs, the cells' bounds leave less than a fifth to compare."""
    known = applications(spark, sf_dir).filter("loan_amount IS NOT NULL AND applicant_income IS NOT NULL")
    vec = F.array(F.log1p("loan_amount"), F.log1p("applicant_income")).cast("array<float>")
    left = written(known.select(F.col("ID").alias("q"), vec.alias("vec")), "vectors")
    store = left.withColumnRenamed("q", "s")
    n = store.count()
    # A query meets its nearest cell and each centre: as many cells as make both alike, so work does not grow with n squared.
    index = fit_cells(store, n, "l2", 5000, cells=max(64, round(n**0.5)))
    layout = T.StructType([left.schema["q"], store.schema["s"], T.StructField("score", T.DoubleType())])
    first = written(index.first_hits(left, 5, rt._searcher(5, "l2"), layout), "first")
    met = index.compared(index.bounded(left, first, 5))
    return met.agg(F.count("*").alias("n_queries"), F.lit(n * n).cast("long").alias("all_pairs"), (F.sum("compared") * 5 < n * n).alias("most_skipped"))


@query("r6_approximate_join")
def r6_approximate(spark, sf_dir):
    """About the five nearest of each vector, from buckets of random projections; scores are exact."""
    store = table(spark, sf_dir, "embeddings")
    hits, _ = rt.approximate_top_k(store.withColumnRenamed("vec_id", "query_id"), store, 5, "cosine", store_id="vec_id")
    return rounded(hits)


@query("r6_approximate_recall", "SELECT count(*) * 5 AS n_pairs, true AS enough FROM embeddings")
def r6_recall(spark, sf_dir):
    """The pairs of the exact join, and whether the approximate one finds nine in ten of them."""
    store = table(spark, sf_dir, "embeddings")
    asked = store.withColumnRenamed("vec_id", "query_id")
    hits, _ = rt.approximate_top_k(asked, store, 5, "cosine", store_id="vec_id")
    exact = rt.top_k(asked, store, 5, "cosine", store_id="vec_id").select("query_id", "vec_id")
    found = exact.join(hits.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return found.agg(F.count("*").alias("n_pairs"), (F.count("hit") >= rt.RECALL * F.count("*")).alias("enough"))


@query("r7_empty_result", "SELECT vec_id AS query_id, CAST(0 AS INT) AS n_hits, '' AS chunks FROM embeddings")
def r7(spark, sf_dir):
    """Every vector asks a store that holds nothing, and gets an empty list."""
    queries = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "query_id")
    store = table(spark, sf_dir, "embeddings").filter("label < 0").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.lit("").alias("chunk"), "embedding"
    )
    found = rt.retrieved(queries, store)
    return found.select("query_id", F.size("chunks").alias("n_hits"), F.array_join("chunks", "\n").alias("chunks"))


def prompt_sql(compat: bool) -> str:
    shown = lambda c: f"coalesce({c}::VARCHAR, 'None')"
    head = "'Explain briefly why a loan application was ' || upper(decision) || ' based on the context.' || chr(10)"
    fields = (
        f"'Income: $' || {shown('applicant_income')} || ', Loan amount: $' || {shown('loan_amount')} || ', Loan type code: ' || {shown('loan_type')}"
    )
    if compat:
        body = f"{head} || 'Context: ' || c || chr(10) || {fields} || chr(10) || 'Explanation:'"
    else:
        words = f"list_filter(string_split_regex(c, '{BLANK_CLASS}'), lambda w: w <> '')"
        body = f"{head} || {fields} || chr(10) || 'Context: ' || array_to_string({words}, ' ') || chr(10) || 'Explanation:'"
    return with_apps(
        f"SELECT ID, {body} AS prompt FROM decided JOIN contexts ON ID % n_docs = rank",
        DECIDED,
        ("docs", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rank, text, count(*) OVER () AS n_docs FROM documents"),
        ("contexts", "SELECT rank, n_docs, text || chr(10) || text AS c FROM docs"),
    )


def _prompt(name: str, compat: bool) -> None:
    @query(name, prompt_sql(compat))
    def run(spark, sf_dir):
        """Each application with the text of one document, twice, as its context."""
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        ranks = written(docs.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "docs")
        numbered = _numbered(ranks, "doc_id")
        n = docs.count()
        # Once a document: each is the context of many applications.
        contexts = numbered.select("rank", rt.context_text(F.array("text", "text"), compat).alias("context"))
        rows = decided(spark, sf_dir).withColumn("rank", F.col("ID") % n).join(contexts, "rank")
        prompt = rt.prompt_text(
            F.col("decision"),
            F.col("context"),
            F.col("loan_type"),
            F.col("applicant_income"),
            F.col("loan_amount"),
            compat=compat,
        )
        return rows.select("ID", prompt.alias("prompt"))


def _numbered(placed, key):
    """Row numbers in key order from rows that are already range-partitioned."""
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # one row per partition
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return placed.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("inside"))


_prompt("r8_prompt", False)
_prompt("r8_prompt_compat", True)


@query("r9_explain_flow")
def r9(spark, sf_dir):
    """Search text, three nearest chunks and prompt for every application."""
    store, encoder = chunk_store(spark, sf_dir)
    out = rt.explained(decided(spark, sf_dir, dealt=True), store, encoder)
    return out.select("ID", "decision", "query", F.size("chunks").alias("n_chunks"), "prompt")


def explained_head(out):
    """What does not depend on the chunks found: the decision, the search text, the prompt up to its context, and how many chunks there are."""
    head = F.substring_index("prompt", "\nContext: ", 1)
    return out.select("ID", "decision", "query", F.size("chunks").alias("n_chunks"), head.alias("head"))


@query(
    "r9_explained_heads",
    with_apps(
        "SELECT ID, decision, 'Loan ' || decision || '. Loan type code: ' || coalesce(loan_type::VARCHAR, 'unknown') || '. Applicant income: $' || "
        "coalesce(applicant_income::VARCHAR, 'unknown') || '. Loan amount: $' || coalesce(loan_amount::VARCHAR, 'unknown') || '.' AS query, CAST(3 AS INT) AS n_chunks, "
        "'Explain briefly why a loan application was ' || upper(decision) || ' based on the context.' || chr(10) || 'Income: $' || coalesce(applicant_income::VARCHAR, 'None') || "
        "', Loan amount: $' || coalesce(loan_amount::VARCHAR, 'None') || ', Loan type code: ' || coalesce(loan_type::VARCHAR, 'None') AS head FROM decided",
        DECIDED,
    ),
)
def r9_heads(spark, sf_dir):
    store, encoder = chunk_store(spark, sf_dir)
    return explained_head(rt.explained(decided(spark, sf_dir, dealt=True), store, encoder))
