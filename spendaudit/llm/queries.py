"""Registered queries of the training-data operators, each over its whole table, and their SQL restatements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendaudit.llm import license_rules
from spendaudit.llm.chat_format import format_chats
from spendaudit.llm.collocations import collocations
from spendaudit.llm.decontaminate import decontaminate
from spendaudit.llm.jaccard_join import similar_classes
from spendaudit.llm.license_rules import license_scan
from spendaudit.llm.line_dedup import dedup_lines
from spendaudit.llm.merkle_manifest import merkle_manifest
from spendaudit.llm.quality_cnn import held_out, score_documents, train
from spendaudit.llm.quality_rules import compression_bands
from spendaudit.llm.scaled_sketch import compare_with_next
from spendaudit.llm.secret_scan import secret_scan
from spendaudit.llm.sentencepiece_codec import encode_documents
from spendaudit.llm.warc import normalise, read_records, shared_folder, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_file())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, flag="n_lines_cut").select("doc_id", "n_lines_cut", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "part", "n_turns", "n_equal", "n_part_turns", F.sha2("text", 256).alias("text_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, members = shared_folder(spark, "warc-streams"), shared_folder(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), whole)
    records = read_records(normalise(archives, whole, members, remove_source=True), members)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "sentences", "licences", "kinds")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_novel", F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claimed = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), claimed_text=claimed)


def op13_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_compression_bands, op2_sentencepiece, op3_line_dedup, op4_quality_cnn, op5_chat_format, op6_jaccard_join,
        op7_decontaminate, op8_warc, op9_license_rules, op10_secret_scan, op11_collocations,
        op12_merkle_manifest, op13_scaled_sketch,
    )
}


CHATS = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         sha256(concat(role IS NULL, '|', text IS NULL, '|', sha256(coalesce(role, '')), sha256(coalesce(text, '')))) AS told
  FROM turns),
prefixes AS (SELECT conv_id, place, n_turns, string_agg(told, ',') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM placed),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_equal FROM prefixes WHERE place = n_turns GROUP BY prefix),
kept AS (SELECT conv_id, n_equal FROM whole WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE place < n_turns))
SELECT conv_id, (place - 1) // 64 AS part, any_value(n_turns) AS n_turns, any_value(n_equal) AS n_equal, count(*) AS n_part_turns,
       sha256(string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place))
         AS text_sha256
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, part
"""

# Words of a text with only A-Z lowered: DuckDB's lower() would change other letters.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS phrase
  FROM items WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS spot FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT p.doc_id, p.spot, p.size, x.item_id FROM places p JOIN windows x ON x.size = p.size AND x.phrase = array_to_string(p.w[p.spot:p.spot + p.size - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + size)) AS word FROM hits) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
        FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
"""

WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, max(page_id) AS first_page FROM payloads WHERE strlen(html) >= 1000 GROUP BY payload_digest)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first_page > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page > page_id THEN first_page END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
"""


def licences_sql() -> str:
    sentences = ", ".join(f"('{letter}', '{sentence}')" for letter, sentence in license_rules.SENTENCES.items())
    rules = ", ".join(f"('{sequence}', '{licence}', '{kind}')" for sequence, licence, kind in license_rules.RULES)
    pattern = "|".join(sequence for sequence, _, _ in license_rules.RULES)
    return f"""
WITH known(letter, sentence) AS (VALUES {sentences}), rules(sequence, licence, kind) AS (VALUES {rules}),
cut AS (
  SELECT doc_id, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{license_rules.SENTENCE_END}')) AS sentence,
         generate_subscripts(regexp_split_to_array(coalesce(text, ''), '{license_rules.SENTENCE_END}'), 1) AS place
  FROM documents),
met AS (
  SELECT doc_id, count(*) AS n, string_agg(letter, '' ORDER BY place) AS letters
  FROM cut JOIN known ON trim(regexp_replace(cut.sentence, '[^a-z0-9]+', ' ', 'g')) = known.sentence GROUP BY doc_id),
found AS (SELECT doc_id, unnest(regexp_extract_all(letters, '{pattern}')) AS sequence FROM met),
named AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
  FROM found JOIN rules USING (sequence) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(letters, '') AS sentences, coalesce(licences, '') AS licences, coalesce(kinds, '') AS kinds
FROM documents LEFT JOIN met USING (doc_id) LEFT JOIN named USING (doc_id)
"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
phrases AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM words),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS a FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM found, (VALUES (1), (2)) AS places(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score, c.k
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.size = c.k AND x.phrase = c.head
              JOIN f y ON y.lang = c.lang AND y.size = c.size - c.k AND y.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part AS phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM found WHERE size = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM weakest s LEFT JOIN longer USING (lang, phrase) WHERE size = 3 OR longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
       r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


# Every least run of lines with ten words that a smaller id holds goes, whichever pair of documents was aligned for it.
_BLANK = "[\\x20\\x09-\\x0D]+"
LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
worded AS (
  SELECT doc_id, spot, regexp_replace(line, '^{_BLANK}|{_BLANK}$', '', 'g') AS line, len(list_filter(regexp_split_to_array(line, '{_BLANK}'), lambda w: w <> '')) AS n
  FROM lines),
placed AS (
  SELECT doc_id, spot, line, row_number() OVER w AS i, sum(n) OVER w AS stop, sum(n) OVER w - n AS start
  FROM worded WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY spot)),
texts AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM placed GROUP BY doc_id),
runs AS (
  SELECT a.doc_id, a.i AS i, b.i AS j FROM placed a ASOF JOIN placed b ON a.doc_id = b.doc_id AND a.start + 10 <= b.stop
  UNION SELECT b.doc_id, a.i, b.i FROM placed b ASOF JOIN placed a ON a.doc_id = b.doc_id AND b.stop - 10 >= a.start),
named AS (SELECT doc_id, i, j, md5(array_to_string(ls[i:j], chr(10))) AS run FROM runs JOIN texts USING (doc_id)),
held AS (SELECT run, min(doc_id) AS first FROM named GROUP BY run),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM named JOIN held USING (run) WHERE first < doc_id),
gone AS (SELECT doc_id, spot FROM cut JOIN placed USING (doc_id, i)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY spot) AS text FROM lines ANTI JOIN gone USING (doc_id, spot) GROUP BY doc_id),
edited AS (
  SELECT g.doc_id, g.n, CASE WHEN g.n < len(t.ls) THEN k.text ELSE '' END AS text
  FROM (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g JOIN texts t USING (doc_id) LEFT JOIN kept k USING (doc_id)),
result AS (SELECT d.doc_id, coalesce(e.n, 0) AS n, CASE WHEN e.n IS NULL THEN d.text ELSE e.text END AS text FROM documents d LEFT JOIN edited e USING (doc_id))
SELECT doc_id, n::BIGINT AS n_lines_cut, length(text)::BIGINT AS n_chars_kept, sha256(text) AS text_sha256 FROM result
"""


def merkle_sql(levels: int = 11, source_levels: int = 7) -> str:
    """Level by level, for up to 3 ** ``levels`` rows a source and 3 ** ``source_levels`` sources; a complete tree stays as it is.
    The crc32 of the decimal id is worked out bit by bit."""

    def digested(text: str) -> str:
        fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + "))"

    def tree(name: str, lowest: str, key: str, height: int) -> str:
        """CTEs ``name_k`` (key, pos, n, d) of every level and ``name_run_k`` (key, run, n, ds) of their runs."""
        parts = [f"{name}_0 AS ({lowest})"]
        for k in range(height):
            parts.append(f"{name}_run_{k} AS MATERIALIZED (SELECT {key}, pos // 3 AS run, any_value(n) AS n, list(d ORDER BY pos) AS ds FROM {name}_{k} GROUP BY {key}, pos // 3)")
            parts.append(f"{name}_{k + 1} AS (SELECT {key}, run AS pos, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {name}_run_{k})")
        return ",\n".join(parts)

    def climb(name: str, before: str, key: str, height: int) -> str:
        """CTEs that add the siblings of every level to ``proof`` and fold ``folded`` up to the tree's root."""
        parts = []
        for k in range(height):
            slot = f"pos // {3**k} % 3"
            left, right = f"array_to_string(ds[1:{slot}], '')", f"array_to_string(ds[{slot} + 2:], '')"
            parts.append(
                f"{name}_climb_{k} AS (SELECT c.* REPLACE (CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, "
                f"CASE WHEN r.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded) "
                f"FROM {before} c JOIN {name}_run_{k} r ON r.{key} = c.{key} AND r.run = c.pos // {3 ** (k + 1)})"
            )
            before = f"{name}_climb_{k}"
        return ",\n".join(parts)

    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    even = f"list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bit}) & 1 = 1"  # the last step inverts all bits
    leaves = "SELECT tree, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, d FROM claims WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d)"
    tops = f"SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, d FROM source_{levels}"
    return f"""
WITH claims AS MATERIALIZED (
  SELECT coalesce('=' || source, '') AS tree, doc_id, {digested("text")} AS d,
         {digested(f"(CASE WHEN {even} THEN replace(text, chr(10), '') ELSE text END)")} AS claimed FROM documents),
{tree("source", leaves, "tree", levels)},
{tree("top", tops, "tree", source_levels)},
placed AS (
  SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, doc_id, d AS leaf, claimed AS folded, '' AS proof FROM claims),
{climb("source", "placed", "tree", levels)},
ranked AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM source_{levels}),
outer_placed AS (SELECT c.doc_id, c.leaf, c.folded, c.proof, r.subroot, r.pos, 0 AS tree FROM source_climb_{levels - 1} c JOIN ranked r USING (tree)),
{climb("top", "outer_placed", "tree", source_levels)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified
FROM top_climb_{source_levels - 1}, top_{source_levels}
"""


ORACLES = {
    "op3_line_dedup": LINE_DEDUP, "op5_chat_format": CHATS, "op6_jaccard_join": JACCARD, "op7_decontaminate": DECONTAMINATION, "op8_warc": WARC,
    "op9_license_rules": licences_sql(), "op11_collocations": COLLOCATIONS,
    "op12_merkle_manifest": merkle_sql(),
}
