"""The queries of this package and the SQL that states them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op2_line_dedup",
    f"""
WITH rows_in AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, string_split(text, chr(10)) AS a FROM rows_in),
lines AS (SELECT r, doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM split),
keys AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS f FROM keys WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT r, line, pos, f IS NOT NULL AND doc_id IS DISTINCT FROM f AS gone FROM keys LEFT JOIN firsts USING (k)),
sums AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM sums JOIN rows_in USING (r)""",
)
def op2_line_dedup(spark, sf_dir):
    from tickwright.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


WORDS = f"regexp_extract_all({LOWER.format('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op1_decontaminate",
    f"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS win FROM starts),
phrases AS (SELECT item_id, array_to_string(win, ' ') AS p, len(win) AS n FROM windows),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS s FROM docs WHERE len(w) > 0),
grams AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS p
          FROM places, (SELECT DISTINCT n FROM phrases) WHERE s + n - 1 <= len(w)),
found AS (SELECT doc_id, s, n, item_id FROM grams JOIN phrases USING (p, n)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def op1_decontaminate(spark, sf_dir):
    from tickwright.llm.decontaminate import mark_contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op4_token_count")
def op4_token_count(spark, sf_dir):
    from tickwright.llm.token_count import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op7_telephony")
def op7_telephony(spark, sf_dir):
    from tickwright.llm.telephony import decode_media, encode_media
    from tickwright.llm.text import stored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # texts that begin alike lie together, so that the pages' compression finds copies
    dense = {"level": 9, "page_bytes": 8 << 20}
    media = stored(encode_media(docs.sortWithinPartitions("text")), "media", **dense)
    return stored(decode_media(media), "pcm", **dense).drop("pcm").withColumnRenamed("id", "doc_id")


@query(
    "op10_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
heads AS (SELECT html, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN head IS NOT NULL AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN heads ON p.html = heads.html AND n >= 1000""",
)
def op10_warc(spark, sf_dir):
    from tickwright.llm.warc import archive_pages, read_archives

    manifest = archive_pages(table(spark, sf_dir, "pages"))
    rows = read_archives(manifest, payloads=False)
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    from tickwright.llm.language_id import held_out, identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    from tickwright.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op8_packing")
def op8_packing(spark, sf_dir):
    from tickwright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    from tickwright.llm.language_id import held_out
    from tickwright.llm.toxicity import sample_and_fit, score_texts

    docs = table(spark, sf_dir, "documents")
    model = sample_and_fit(docs, table(spark, sf_dir, "labels"))
    found = score_texts(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


@query("op5_context_tree")
def op5_context_tree(spark, sf_dir):
    from tickwright.llm.context_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op13_bpe")
def op13_bpe(spark, sf_dir):
    from tickwright.llm.bpe_trie import round_trip

    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query(
    "op12_prefix_trie",
    r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i, k, w FROM (
    SELECT conv_id, turn, left(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), 32) AS k,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
crcs AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)),
heads AS (SELECT crcs.c, i AS d, k, w FROM crcs JOIN turns ON turns.c = base AND i <= h),
taken AS (SELECT c, count(*) AS n FROM heads GROUP BY c),
steps AS (
  SELECT * FROM heads UNION ALL
  SELECT crcs.c, i - h + coalesce(n, 0), k, w FROM crcs JOIN turns ON turns.c = crcs.c AND i > h LEFT JOIN taken ON taken.c = crcs.c),
members AS (
  SELECT c, 0 AS d, '' AS p, 0 AS w FROM crcs UNION ALL
  SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), w FROM steps),
nodes AS (SELECT p, d, left(p, greatest(d - 1, 0) * 32) AS up, min(c) AS c, count(*) AS n, any_value(w) AS w FROM members GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY up),
sized AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p)),
below AS (
  SELECT members.p, count(*) FILTER (k = 0) AS n_leaves, sum((n - 1) * sized.w) AS saved
  FROM sized JOIN members ON members.c = sized.c AND members.d <= sized.d GROUP BY members.p),
ends AS (
  SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e
  FROM (SELECT c, p, d, max(d) OVER (PARTITION BY c) AS last FROM members) WHERE d = last GROUP BY p)
SELECT sized.c AS conv_id, sized.d AS depth, above.c AS parent_conv_id, sized.n AS n_convs, sized.k AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM sized JOIN below USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes AS above ON above.p = sized.up AND sized.d > 0""",
)
def op12_prefix_trie(spark, sf_dir):
    from tickwright.llm.conversation_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def _lloyd_sql() -> str:
    """Three assignments with all distances, two updates between them."""
    number = "CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)"
    fours = ", ".join(f"v[p * 4 + {i + 1}] AS {c}" for i, c in enumerate("abcd"))
    apart = " + ".join(f"(parts.{c} - b.{c}) * (parts.{c} - b.{c})" for c in "abcd")
    steps = []
    for i in range(3):
        steps.append(f"a{i} AS (SELECT r, p, min(({apart}) * 64 + e) AS m FROM parts JOIN b{i} AS b USING (p) GROUP BY r, p)")
        if i < 2:
            mean = ", ".join(f"(sum({c}) - ((sum({c}) % count(*)) + count(*)) % count(*)) // count(*) AS {c}" for c in "abcd")
            kept = ", ".join(f"coalesce(n.{c}, b.{c}) AS {c}" for c in "abcd")
            steps.append(f"n{i} AS (SELECT p, m % 64 AS e, {mean} FROM parts JOIN a{i} USING (r, p) GROUP BY ALL)")
            steps.append(f"b{i + 1} AS (SELECT p, e, {kept} FROM b{i} AS b LEFT JOIN n{i} AS n USING (p, e))")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: {number}) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, {fours} FROM kept, (SELECT unnest(generate_series(0, 15)) AS p)),
b0 AS (SELECT p, r AS e, a, b, c, d FROM parts WHERE r < 64),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64) AS error FROM a2 GROUP BY r),
book AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS digest FROM b2)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM kept JOIN coded USING (r), book"""


@query("op11_vector_codes", _lloyd_sql())
def op11_vector_codes(spark, sf_dir):
    from tickwright.llm.vector_codes import books_digest, compress

    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
