"""The registered queries of the training-data operators, with production parameters and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import collocations, hmm, hnsw, kmeans_tree, language, minhash, packing, spans, substrings, tokens, toxicity, trie
from meshlake.llm.scratch import small_batches

QUERIES = {}
ORACLES: dict[str, str] = {}

#: Words of a text: lower-cased A-Z, anything but white space.
WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

#: Smallest id reachable over links(a, b), both ways, from every row of nodes(id).
REACHED = """
reached AS (
  SELECT id, id AS other FROM nodes
  UNION
  SELECT reached.id, links.b FROM reached JOIN links ON reached.other = links.a
),
roots AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
"""

ORACLES["op1_hnsw_near_dedup"] = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS size
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b
  FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / x.size / y.size >= 0.93
),
nodes AS (SELECT vec_id AS id FROM embeddings), {REACHED}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots ON vec_id = id
"""

ORACLES["op9_minhash_near_dedup"] = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {WORDS} AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM worded
),
named AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM shingled),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM named x JOIN named y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
nodes AS (SELECT doc_id AS id FROM documents), {REACHED}
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM shingled JOIN roots ON doc_id = id
"""

ORACLES["op10_sentence_spans"] = f"""
WITH parts AS (  -- a word with the white space behind it
  SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS part
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS p FROM documents)
),
stops AS (
  SELECT *, regexp_matches(part, '^[^\x20\x09-\x0D]*[.!?]([\x20\x09-\x0D]|$)') OR contains(part, chr(10)) AS stop FROM parts
),
numbered AS (
  SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM stops
),
sentences AS (
  SELECT doc_id, sentence, string_agg(part, '' ORDER BY k) AS text FROM numbered GROUP BY doc_id, sentence
),
keyed AS (
  SELECT doc_id, sentence, text, array_to_string({WORDS}, ' ') AS words, count(*) OVER (PARTITION BY doc_id) AS n FROM sentences
),
runs AS (
  SELECT doc_id, sentence, n, words || coalesce(' ' || lead(words, 1) OVER w, '') || coalesce(' ' || lead(words, 2) OVER w, '') AS span
  FROM keyed WINDOW w AS (PARTITION BY doc_id ORDER BY sentence)
),
later AS (
  SELECT doc_id, sentence FROM runs WHERE sentence = 0 OR sentence + 3 <= n
  QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id, sentence) > 1
),
gone AS (SELECT DISTINCT later.doc_id, later.sentence + s AS sentence FROM later, range(3) t(s)),
judged AS (
  SELECT keyed.*, gone.doc_id IS NOT NULL AS cut FROM keyed LEFT JOIN gone ON keyed.doc_id = gone.doc_id AND keyed.sentence = gone.sentence
),
cleaned AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (cut) AS n_removed, string_agg(text, '' ORDER BY sentence) FILTER (NOT cut) AS kept FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE regexp_extract(d.text, '^[\x20\x09-\x0D]*') || coalesce(kept, '') END AS text
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
"""

ORACLES["op11_phrase_collocations"] = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, n AS k, array_to_string(w[i:i + n - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, range(1, 5) t(n)) GROUP BY lang, k, phrase HAVING count(*) >= 30
),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (2000000 * c.a::HUGEINT // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM candidates, range(2, 4) t(n) WHERE n < k) GROUP BY ALL
),
kept AS (SELECT w.* FROM worst w LEFT JOIN inner_parts p ON p.lang = w.lang AND p.phrase = w.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes ON sizes.lang = ranked.lang WHERE rank <= 2000
"""

ORACLES["op12_suffix_array_dedup"] = """
WITH bytes AS (SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT row_id, doc_id, unnest(range(0, length(h) // 2)) AS p, h FROM bytes),
strings AS (SELECT row_id, p, substring(h, 2 * p + 1, 2) AS byte, CASE WHEN 2 * p + 400 <= length(h) THEN md5(substring(h, 2 * p + 1, 400)) END AS s FROM places),
judged AS (SELECT row_id, p, byte, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS again FROM strings),
covered AS (SELECT row_id, p, byte, max(again) OVER (PARTITION BY row_id ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM judged),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row_id ORDER BY p), false) AS edge FROM covered),
kept AS (SELECT row_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (edge) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS h FROM edges GROUP BY row_id)
SELECT doc_id, length(b.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM bytes b LEFT JOIN kept k ON b.row_id = k.row_id
"""

#: CRC-32 of a text of ASCII characters.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLES["op13_conversation_trie"] = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.i, 0 AS own, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL
  SELECT c.conv_id, t.i, 1, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h
),
paths AS (
  SELECT conv_id, count(*) OVER w AS depth, list({{'role': role, 'text': text}}) OVER w AS prefix, length(text) AS size FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
  UNION ALL
  SELECT conv_id, 0, [], 0 FROM convs
),
ended AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
  SELECT min(p.conv_id) AS conv_id, p.depth, prefix, any_value(size) AS size, count(*) AS n_convs,
    sha256(coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id), '')) AS ends_sha256
  FROM paths p LEFT JOIN ended e ON p.conv_id = e.conv_id AND p.depth = e.depth
  GROUP BY p.depth, prefix
),
parents AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
tree AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN kids k ON p.conv_id = k.conv_id AND p.depth = k.depth),
summed AS (  -- a node and its ancestors are on its smallest member's path
  SELECT prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT paths.prefix, tree.n_children, tree.n_convs, tree.size FROM tree JOIN paths ON paths.conv_id = tree.conv_id AND paths.depth <= tree.depth) GROUP BY prefix
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM tree JOIN summed USING (prefix)
"""


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


@query
def op1_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of embeddings of one label with a cosine of 0.93 or more."""
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 0.93)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds other than 1 of 3."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(fold(3) != 1))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "match")


@query
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with segment-tree BPE and decoded again, as digests."""
    return tokens.round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op4_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row with a vec_id divisible by 20."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kmeans_tree.nearest(rows, rows.where("vec_id % 20 = 0"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return tokens.count(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, 0)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels in the folds other than 0 of 5."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(5) != 0)
    net = toxicity.train(docs, labels)
    return toxicity.score(docs, net).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op8_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of those in the folds other than 0 of 10."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("learn", F.coalesce(fold(10) != 0, F.lit(False)))
    found = hmm.score(docs)
    return found.select("doc_id", F.coalesce(fold(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), 75)


@query
def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one has."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(docs).select("doc_id", "n_sentences", "n_removed", "text")


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of all documents."""
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"), 30, 2000)


@query
def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeated strings of 200 bytes cover, as counts and a digest."""
    found = substrings.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return trie.nodes(read(spark, sf_dir, "conversations"), 100, 6)
