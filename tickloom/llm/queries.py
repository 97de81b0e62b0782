"""One query for each operator of this package over the given tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    chat,
    exact_dups,
    merkle,
    mixing,
    near_dups,
    packing,
    periodic_runs,
    quality,
    search,
    substrings,
    token_files,
    toxicity,
    warc,
)
from tickloom.llm.common import located, stage_table
from tickloom.plans.settings import scratch_path


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.digest_tokens(token_files.read_tokens(spark, path))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), ["doc_id"])
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_kept(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.mark_near_duplicates(_table(spark, sf_dir, "documents"))


# The table has no fetch times.
PAGES_FETCHED = "2024-01-01T00:00:00Z"


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(_table(spark, sf_dir, "pages"), PAGES_FETCHED), ["page_id"])
    return records.drop("date")


# Both texts consist of control strings of the template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tokenizer = scratch_path(spark, "chat"), _tokenizer("byte_bpe_50k.json")
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string"
    )
    chat.write_trees(given.unionByName(probe), path, tokenizer)
    return chat.digest_conversations(chat.read_turns(spark, path, tokenizer))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packing with the settings of the corpus: its tokenizer, end id and window."""
    pieces = stage_table(packing.cut_pieces(docs, _tokenizer("word_bpe_49k.json"), end_id=1), "pieces")
    return packing.pack(pieces)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return search.search(vectors, vectors.filter("vec_id % 100 = 0"))


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in LEAF_COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(lowered))
    proofs = merkle.proofs(merkle.manifest(docs, LEAF_COLUMNS, "source", "doc_id", tampered))
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest("levels").alias("proof_sha256"),
        merkle.folded("presented", "levels").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = periodic_runs.looped(F.col("text"), F.crc32(F.col("doc_id").cast("string")))
    found = periodic_runs.find_runs(docs.select("doc_id", text.alias("text")), ["doc_id"])
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    thousandfold = 1000 * F.col("best.length")
    return found.withColumn("best", periodic_runs.greatest_run("runs")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        # Without its remainder the division is exact.
        ((thousandfold - thousandfold % F.col("best.period")) / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact_dups.mark_exact_duplicates(located(_table(spark, sf_dir, "documents")))
    return marks.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_quality_rules": op2_quality_rules,
    "op3_source_mix": op3_source_mix,
    "op4_toxicity": op4_toxicity,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_chat_trees": op8_chat_trees,
    "op9_packing": op9_packing,
    "op10_ball_tree_search": op10_ball_tree_search,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_duplicates": op13_exact_duplicates,
}


# All HTML names with their characters, for the SQL's own decoder.
SQL_NAMES = "map([{}], [{}])".format(*(", ".join("'" + x.replace("'", "''") + "'" for x in part) for part in zip(*sorted(html5.items()))))


def _sql_pattern(pattern: str, flags: str = "is") -> str:
    return f"(?{flags})" + pattern.replace("END", r"\z").replace("'", "''")


def _sql_decoded(text: str, attribute: bool = False) -> str:
    """Cut at the references, decode each (numbers, or the longest name it begins with), and join again."""
    pattern = _sql_pattern(warc.REFERENCE, "s")
    name, n = "substr(ref, 2)", "longest"
    longest = f"coalesce(list_max(list_filter(range(2, 1 + length({name})), lambda k: chars[substr({name}, 1, k)] IS NOT NULL)), 0)"
    number = f"chr(CAST(CASE WHEN lower({name}) LIKE '#x%' THEN '0x' || regexp_extract({name}, '[0-9a-fA-F]+') ELSE regexp_extract({name}, '[0-9]+') END AS INTEGER))"
    named = f"chars[substr({name}, 1, {longest})] || substr({name}, {longest} + 1)"
    kept = f"{longest} < length({name}) AND regexp_matches(substr({name}, {longest} + 1, 1), '[=A-Za-z0-9]')" if attribute else "false"
    one = f"CASE WHEN {name} LIKE '#%' THEN {number} WHEN {longest} = 0 OR {kept} THEN ref ELSE {named} END"
    refs = f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda ref: {one if attribute else f'replace({one}, chr(160), chr(32))'})"
    pieces = f"regexp_split_to_array({text}, '{pattern}')"
    return f"array_to_string(list_transform(list_zip({pieces}, {refs}), lambda p: concat(p[1], p[2])), '')"


def _sql_links(html: str) -> str:
    """The href of each anchor that has one, without quotes and control characters, decoded."""
    values = f"list_transform(regexp_extract_all({html}, '{_sql_pattern(warc.ANCHOR)}'), lambda a: regexp_extract(a, '(?is)\\shref\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>]+)', 1))"
    bare = f"list_transform(list_filter({values}, lambda v: v <> ''), lambda v: regexp_replace(regexp_replace(v, '[\\x00-\\x1F]', '', 'g'), '^[\"'']|[\"'']$', '', 'g'))"
    return f"list_transform({bare}, lambda v: trim(regexp_replace({_sql_decoded('v', attribute=True)}, '[\\x00-\\x1F]', '', 'g')))"


def _sql_id(*parts: str) -> str:
    joined = " || chr(10) || ".join(f"coalesce('=' || {p}, '-')" for p in parts)
    m = f"md5({joined})"
    cuts = " || '-' || ".join(f"substr({m}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('<urn:uuid:' || {cuts} || '>')"


CRLF = "chr(13) || chr(10)"
SQL_WARC = f"""
    WITH names AS (SELECT {SQL_NAMES} AS chars),
    pages_ AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
    raw AS (
        SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '{_sql_pattern(warc.HIDDEN)}', ' ', 'g'), '{_sql_pattern(warc.BREAKING)}', chr(10), 'g'),
                                 '{_sql_pattern(warc.TAG)}', '', 'g') AS bare,
               regexp_extract(html, '{_sql_pattern(warc.TITLE)}', 1) AS raw_title
        FROM pages_
    ),
    facts AS (
        SELECT page_id, url, {_sql_id("'response'", "page_id", "url")} AS source, 'sha256:' || sha256(html) AS source_digest,
               regexp_replace(regexp_replace(regexp_replace({_sql_decoded("bare")}, '{warc.SPACES}', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'),
                              '^[ \\n]+|[ \\n]+$', '', 'g') AS text,
               trim(regexp_replace({_sql_decoded("raw_title")}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS title,
               regexp_extract(regexp_extract(html, '{_sql_pattern(warc.ROOT)}'), '{_sql_pattern(warc.LANGUAGE)}', 1) AS language,
               {_sql_links("html")} AS links, strlen(html) AS length
        FROM raw, names
    ),
    blocks AS (
        SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
               'source-content-type: text/html; charset=utf-8' || {CRLF} || 'source-payload-digest: ' || source_digest || {CRLF}
               || CASE WHEN title <> '' THEN 'title: ' || title || {CRLF} ELSE '' END
               || CASE WHEN language <> '' THEN 'language: ' || language || {CRLF} ELSE '' END
               || 'links: ' || len(links) || {CRLF} || 'text-digest: sha256:' || sha256(text) || {CRLF}
               || 'source-http-line: HTTP/1.1 200 OK' || {CRLF} || 'source-http-line: Content-Type: text/html; charset=utf-8' || {CRLF}
               || 'source-http-line: Content-Length: ' || length || {CRLF}
               || array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {CRLF}), '') AS block
        FROM facts
        UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM facts
    ),
    named AS (SELECT *, {_sql_id("record_type", "source")} AS record_id, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM blocks)
    SELECT page_id, record_type, record_id, source AS refers_to, url AS target_uri, content_type,
           'text/html; charset=utf-8' AS source_content_type, source_digest, block, block_digest, content_length,
           'WARC/1.1' || {CRLF} || 'WARC-Type: ' || record_type || {CRLF} || 'WARC-Record-ID: ' || record_id || {CRLF}
           || 'WARC-Refers-To: ' || source || {CRLF} || coalesce('WARC-Target-URI: ' || url || {CRLF}, '')
           || 'WARC-Date: {PAGES_FETCHED}' || {CRLF} || 'WARC-Source-Payload-Digest: ' || source_digest || {CRLF}
           || 'WARC-Block-Digest: ' || block_digest || {CRLF} || 'Content-Type: ' || content_type || {CRLF}
           || 'Content-Length: ' || content_length || {CRLF} AS headers
    FROM named
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# CRC-32 of the decimal digits of an id: the table of all bytes by its rule, then one step a digit.
SQL_CRC_TABLE = """(SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""


def _sql_crc(value: str) -> str:
    digits = f"list_transform(range(1, 1 + length({value})), lambda i: CAST(ascii(substr({value}, CAST(i AS INTEGER), 1)) AS BIGINT))"
    return f"xor(list_reduce({digits}, lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _sql_leaf(text: str) -> str:
    parts = [f"CAST({c} AS VARCHAR)" for c in LEAF_COLUMNS[:-1]] + [text]
    whole = ", ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts)
    return f"sha256(concat({whole}))"


def _sql_levels(name: str, leaves: str, part: str, levels: int) -> str:
    """Tables ``{name}0`` .. of a tree's nodes (part, pos, node, n) and ``{name}_runs{k}`` of the runs that hash to the next level."""
    made = [f"{name}0 AS (SELECT {part} AS part, pos, node, count(*) OVER (PARTITION BY {part}) AS n FROM {leaves})"]
    for k in range(levels):
        made.append(
            f"""{name}_runs{k} AS (
                SELECT part, pos // 16 AS pos, list(node ORDER BY pos) AS run, any_value(n) AS n,
                       CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node
                FROM {name}{k} GROUP BY part, pos // 16
            ),
            {name}{k + 1} AS (SELECT part, pos, node, (n + 15) // 16 AS n FROM {name}_runs{k})"""
        )
    return ", ".join(made)


def _sql_side(table: str, first: str, last: str) -> str:
    """Siblings of a run joined; none where the level is not hashed."""
    return f"CASE WHEN {table}.n > 1 THEN array_to_string({table}.run[{first}:{last}], '') ELSE '' END"


# Levels that the SQL unrolls: up to 16 ** 5 documents a source and 16 ** 3 sources.
SQL_LEVELS, SQL_TOPS = 5, 3


def _sql_merkle() -> str:
    levels = [(f"r{k}", f"(l.pos // {16**k}) % 16") for k in range(SQL_LEVELS)] + [(f"t{k}", f"(s.pos // {16**k}) % 16") for k in range(SQL_TOPS)]
    joins = [f"JOIN low_runs{k} AS r{k} ON r{k}.part = s.pos AND r{k}.pos = l.pos // {16 ** (k + 1)}" for k in range(SQL_LEVELS)]
    joins += [f"JOIN top_runs{k} AS t{k} ON t{k}.pos = s.pos // {16 ** (k + 1)}" for k in range(SQL_TOPS)]
    sides = [f"{_sql_side(t, '1', pos)} AS left_{t}, {_sql_side(t, f'{pos} + 2', '16')} AS right_{t}, {t}.n AS n_{t}" for t, pos in levels]
    folds, table, node = [], "paths", "shown"
    for t, _ in levels:
        above = f"CASE WHEN n_{t} > 1 THEN sha256(left_{t} || {node} || right_{t}) ELSE {node} END AS node_{t}"
        folds.append(f"fold_{t} AS (SELECT *, {above} FROM {table})")
        table, node = f"fold_{t}", f"node_{t}"
    proof = " || ".join(f"left_{t} || right_{t}" for t, _ in levels)
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
        WITH crc AS {SQL_CRC_TABLE},
        hashed AS (
            SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
                   CASE WHEN {_sql_crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_sql_leaf(lowered)} END AS changed
            FROM documents, crc
        ),
        sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM (SELECT DISTINCT source FROM documents)),
        leaves AS (
            SELECT doc_id, leaf AS node, coalesce(changed, leaf) AS shown, s.pos AS source_pos,
                   row_number() OVER (PARTITION BY s.pos ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
            FROM hashed AS h JOIN sources AS s ON h.source IS NOT DISTINCT FROM s.source
        ),
        {_sql_levels("low", "leaves", "source_pos", SQL_LEVELS)},
        subroots AS (SELECT part AS pos, node, 0 AS whole FROM low{SQL_LEVELS}),
        {_sql_levels("top", "subroots", "whole", SQL_TOPS)},
        paths AS (
            SELECT l.doc_id, l.node AS leaf, l.shown, s.node AS subroot, whole.node AS root, {', '.join(sides)}
            FROM leaves AS l JOIN subroots AS s ON l.source_pos = s.pos {' '.join(joins)}, top{SQL_TOPS} AS whole
        ),
        {', '.join(folds)}
        SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {node} AS folded_root, {node} = root AS verified
        FROM {table}
    """


SQL_RUNS = rf"""
    WITH crc AS {SQL_CRC_TABLE},
    given AS (
        SELECT row_number() OVER () AS r, doc_id, {_sql_crc('CAST(doc_id AS VARCHAR)')} AS h,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, CAST(len(ws) AS BIGINT) AS n
        FROM documents, crc
    ),
    looped AS (SELECT *, h // 10 AS g, g % nullif(n, 0) AS a, 1 + (n - a) // (3 + g % 8) AS p FROM given),
    words AS (
        SELECT r, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w
        FROM looped, LATERAL (SELECT unnest(range(n)) AS i)
    ),
    equal_words AS (
        SELECT x.r, x.i, y.i - x.i AS q FROM words AS x JOIN words AS y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
    ),
    islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal_words),
    stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
    runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
    listed AS (
        SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
        FROM runs GROUP BY r
    ),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
    dropped AS (SELECT DISTINCT r, i FROM runs, LATERAL (SELECT unnest(range(start + period, start + length)) AS i)),
    kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM given LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

SQL: dict[str, str] = {
    "op5_repeated_passages": f"""
        WITH split AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS words
            FROM split, LATERAL (SELECT unnest(generate_series(1, len(ws) - 19)) AS i)
        ),
        later AS (
            SELECT doc_id, i FROM windows
            QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1
        ),
        removed AS (
            SELECT doc_id, list(DISTINCT i + k) AS gone
            FROM later, LATERAL (SELECT unnest(generate_series(0, 19)) AS k) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(
                   list_filter(ws, lambda w, k: NOT coalesce(list_contains(gone, k), false)), ' ')) AS kept_sha256
        FROM split LEFT JOIN removed USING (doc_id)
    """,
    "op7_warc_derivatives": SQL_WARC,
    "op8_chat_trees": r"""
        WITH rows AS (
            SELECT conv_id, turn, role, coalesce(role, '') AS r, text, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -1, 0, 'user', 'user', '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]'
        ),
        turns AS (
            SELECT *, length(r) + 1 + length(regexp_replace(t, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g'))
                      + CASE WHEN r = 'assistant' THEN 4 ELSE 15 END AS formatted
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(concat(r, chr(10), t, chr(10)), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
               CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
               CAST(sum(formatted) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
    "op10_ball_tree_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
    "op11_merkle_manifest": _sql_merkle(),
    "op12_periodic_runs": SQL_RUNS,
    "op13_exact_duplicates": f"""
        WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS words FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(words) AS text_sha256
        FROM texts WINDOW same AS (PARTITION BY words)
    """,
}
