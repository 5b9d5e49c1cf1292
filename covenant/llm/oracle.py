"""SQL for DuckDB that gives what a query gives, where SQL can say it, from the definitions and by other means."""

from __future__ import annotations

from covenant.llm.line_dedup import LEAST_WORDS as RUN_WORDS
from covenant.llm.repetition import LEAST_WORDS, LINE_LIMIT, MOST_REPEATED_PERCENT, NGRAM_LIMITS
from covenant.llm.spelling import FACTOR, LETTERS, LOWER, SLIP, TIMES, UPPER
from covenant.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

#: Components of the vectors of the given table.
VECTOR_SIZE = 64

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Every run of lines that has just enough words from its start or up to its end, and where it stands first.
LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
    worded AS (SELECT *, len({_WORDS.format('line')}) AS words FROM split),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS place,
        sum(words) OVER (PARTITION BY doc_id ORDER BY no) AS after FROM worded WHERE words > 0),
    lists AS (SELECT doc_id, list(line ORDER BY place) AS lines FROM placed GROUP BY doc_id),
    runs AS (SELECT a.doc_id, a.place AS first, b.place AS last, list_slice(lines, a.place, b.place) AS key
        FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.place <= b.place JOIN lists ON lists.doc_id = a.doc_id
        WHERE b.after - (a.after - a.words) >= {RUN_WORDS}
        AND (b.after - b.words - (a.after - a.words) < {RUN_WORDS} OR b.after - a.after < {RUN_WORDS})),
    copies AS (SELECT * FROM runs QUALIFY min(row(doc_id, first)) OVER (PARTITION BY key) < row(doc_id, first)),
    gone AS (SELECT DISTINCT placed.doc_id, no FROM placed JOIN copies
        ON placed.doc_id = copies.doc_id AND place BETWEEN first AND last),
    marked AS (SELECT split.*, gone.no IS NOT NULL AS deleted FROM split LEFT JOIN gone USING (doc_id, no))
SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (WHERE deleted)::INT AS n_deleted,
    coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT deleted), '') AS text
FROM marked GROUP BY doc_id"""


def _inside(n: int) -> str:
    """Whether a word lies in a window of n words that its text holds twice or more."""
    return f"coalesce(max(twice{n}) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), FALSE) AS inside{n}"


def _window(n: int) -> str:
    return f"""CASE WHEN p <= n_words - {n - 1} THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p
        ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS window{n}"""


def _twice(n: int) -> str:
    return f"window{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, window{n}) > 1 AS twice{n}"


_SIZES = (3, *NGRAM_LIMITS)
_COVERED = " AND ".join(f"coalesce(chars{n} / nullif(word_chars, 0), 0) <= {limit}" for n, limit in NGRAM_LIMITS.items())
QUALITY = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
    counted AS (SELECT doc_id, text, len(words) AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM texts),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS no FROM texts),
    dup_lines AS (SELECT doc_id, count(*) AS n_dup_lines, sum(chars) AS dup_chars FROM
        (SELECT doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars FROM lines
        QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY no) > 1) WHERE chars > 0 GROUP BY doc_id),
    spread AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p, len(words) AS n_words FROM texts),
    windows AS (SELECT doc_id, p, word, {', '.join(map(_window, _SIZES))} FROM spread),
    found AS (SELECT doc_id, p, word, {', '.join(map(_twice, _SIZES))} FROM windows),
    covered AS (SELECT doc_id, word, {', '.join(map(_inside, _SIZES))} FROM found),
    sums AS (SELECT doc_id, count(*) FILTER (WHERE inside3) AS n_repeat_words,
        {', '.join(f'sum(length(word)) FILTER (WHERE inside{n}) AS chars{n}' for n in NGRAM_LIMITS)} FROM covered GROUP BY doc_id),
    all_of AS (SELECT counted.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_chars, 0) AS dup_chars,
        coalesce(n_repeat_words, 0) AS n_repeat_words, {', '.join(f'coalesce(chars{n}, 0) AS chars{n}' for n in NGRAM_LIMITS)}
        FROM counted LEFT JOIN dup_lines USING (doc_id) LEFT JOIN sums USING (doc_id)),
    judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM all_of)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND coalesce(dup_chars / nullif(word_chars, 0), 0) <= {LINE_LIMIT} AND {_COVERED} AS kept FROM judged"""

_MARKED = r"regexp_replace({}, '[^\\<\[\]]', '', 'g')"
CHAT = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(12 + length(role) + length(text) + length({_MARKED.format('role')}) + length({_MARKED.format('text')}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

_FAR = "list_sum(list_transform(list_zip(a.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _assigned(k: int) -> str:
    """The nearest entry of codebooks k to each part, by trying all."""
    return f"""nearest{k} AS (SELECT vec_id, p, a.part, min(struct_pack(far := {_FAR}, e := b.e)) AS best
        FROM parts a JOIN books{k} b USING (p) GROUP BY vec_id, p, a.part)"""


def _moved(k: int) -> str:
    return f"""sums{k} AS (SELECT p, best.e AS e, i, sum(part[i]) AS total, count(*) AS n
        FROM nearest{k}, range(1, 1 + {VECTOR_SIZE // PARTS}) AS places(i) GROUP BY ALL),
    means{k} AS (SELECT p, e, list(floor(total / n)::BIGINT ORDER BY i) AS part FROM sums{k} GROUP BY p, e),
    books{k + 1} AS (SELECT p, e, coalesce(means{k}.part, books{k}.part) AS part FROM books{k} LEFT JOIN means{k} USING (p, e))"""


_ROUNDS = ",\n    ".join(f"{_assigned(k)},\n    {_moved(k)}" for k in range(ROUNDS))
VECTOR_CODES = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS part
        FROM kept, range({PARTS}) AS positions(p)),
    books0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part FROM parts
        QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES}),
    {_ROUNDS},
    {_assigned(ROUNDS)},
    coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code,
        sum(best.far)::BIGINT AS error FROM nearest{ROUNDS} GROUP BY vec_id),
    told AS (SELECT sha256(string_agg(list_aggregate(part, 'string_agg', ','), ',' ORDER BY p, e)) AS books FROM books{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, books AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), told"""

#: crc32 by its table, over the bytes of letters below 256; near words by what is left when a letter goes.
SPELLING = f"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)),
        lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS bytes(b)),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run
        FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LETTERS} GROUP BY ALL),
    spelled AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x:
        CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes FROM counted),
    hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM spelled, crc_table),
    slipped AS (SELECT n, CASE WHEN h % {SLIP} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {TIMES}),
    less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT less.word, words.word, words.n FROM less JOIN words ON rest = words.word
        UNION SELECT words.word, less.word, less.n FROM less JOIN words ON rest = words.word),
    best AS (SELECT word, count(*) AS n_near, min(struct_pack(rank := -n, near := near)) AS best FROM near GROUP BY word),
    formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.rank >= {FACTOR} * n THEN best.near END AS form,
        CASE WHEN -best.rank >= {FACTOR} * n THEN -best.rank END AS form_n FROM words LEFT JOIN best USING (word)),
    steps AS (SELECT word, word AS last FROM words
        UNION ALL SELECT steps.word, form FROM steps JOIN formed ON last = formed.word WHERE form IS NOT NULL)
SELECT formed.word, formed.form, steps.last AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN steps USING (word) JOIN formed AS ends ON steps.last = ends.word WHERE ends.form IS NULL"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op4_chat_format": CHAT,
    "op6_quality_rules": QUALITY,
    "op12_vector_codes": VECTOR_CODES,
    "op13_spelling": SPELLING,
}
