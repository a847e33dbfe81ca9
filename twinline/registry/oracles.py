"""The same answers in SQL, written independently for DuckDB."""

from __future__ import annotations

from twinline.operators.dedup import PRIME, banding, minhash_draws
from twinline.registry.views import RUNS, SYNONYMS

SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SCRIPT = r"[\x{C0}-\x{24F}]"

# DuckDB's levenshtein counts bytes. Clean text has no control characters, so
# each accented letter of the given tables can stand as one of those.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ONE_BYTE = "".join(chr(i + 1) for i in range(len(ACCENTED)))


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(trim(regexp_replace({c}, '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g')), '\s+', ' ', 'g'))"


def _count(c: str) -> str:
    return rf"len(regexp_split_to_array(trim({c}), '\s+'))::INTEGER"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SPACES}'), lambda t: t <> '')"


def _set(c: str) -> str:
    return rf"list_distinct(regexp_split_to_array(lower({c}), '\s+'))"


def _u(key: str, op: str, pos: str = "0") -> str:
    digest = f"md5(concat_ws('|', '42', ({key})::VARCHAR, '{op}', ({pos})::VARCHAR))"
    return f"(concat('0x', substr({digest}, 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _edit_distance(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{ACCENTED}', '{ONE_BYTE}'), translate({b}, '{ACCENTED}', '{ONE_BYTE}'))"


S, T = "source_sentence", "paraphrased_sentence"

OVERLAP = (
    f"len(list_intersect({_set(S)}, {_set(T)}))::DOUBLE"
    f" / len(list_distinct(list_concat({_set(S)}, {_set(T)})))"
)
FEATURE_SQL = {
    "src_len": _count(S),
    "tgt_len": _count(T),
    "src_char_len": f"length({S})::INTEGER",
    "tgt_char_len": f"length({T})::INTEGER",
    "len_ratio": f"CASE WHEN {_count(T)} > 0 THEN {_count(S)}::DOUBLE / {_count(T)} ELSE 0::DOUBLE END",
    "word_overlap": OVERLAP,
    "char_overlap": f"{_edit_distance(S, T)}::DOUBLE / greatest(length({S}), length({T}), 1)",
    "bn_char_ratio": f"length(regexp_replace({S}, '{SCRIPT}', '', 'g'))::DOUBLE / greatest(length({S}), 1)",
}
FEATURE_LIST = ", ".join(f"{sql} AS {name}" for name, sql in FEATURE_SQL.items())
CONTROL_FREE = f"sl, id, {_norm(S)} AS {S}, {_norm(T)} AS {T}"

_synonym_rows = ", ".join(
    "('{}', [{}])".format(k, ", ".join("'" + a.replace("'", "''") + "'" for a in v)) for k, v in SYNONYMS.items()
)

VIEWS = f"""WITH
line_lists AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
pairs AS (
  SELECT doc_id * 4294967296 + k AS sl, doc_id * 4294967296 + k AS id,
         nullif(l[2 * k + 1], '') AS {S}, nullif(l[2 * k + 2], '') AS {T}
  FROM (SELECT doc_id, l, unnest(range(0, (len(l) + 1) // 2)) AS k FROM line_lists)),
conv AS (
  SELECT conv_id * 4294967296 + turn AS sl, conv_id AS id, text AS {S}, next_text AS {T}
  FROM (SELECT *, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'),
normal AS (SELECT {CONTROL_FREE} FROM pairs),
clean AS (
  SELECT * FROM normal
  WHERE {S} IS NOT NULL AND {T} IS NOT NULL AND {S} <> '' AND {T} <> '' AND {S} <> {T}
    AND {_count(S)} BETWEEN 3 AND 256 AND {_count(T)} BETWEEN 3 AND 256),
uniq AS (
  SELECT * FROM clean
  QUALIFY row_number() OVER (PARTITION BY sha256(concat_ws('||', {S}, {T})) ORDER BY id NULLS FIRST, sl) = 1),
feat AS (SELECT *, {FEATURE_LIST} FROM uniq),
dealt AS (
  SELECT sl, CASE WHEN d < 0.8 THEN 'train' WHEN d < 0.9 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT sl, {_u(f"concat_ws('||', {S}, {T})", "split")} AS d FROM uniq)),
freq AS (
  SELECT token, count(*) AS "count"
  FROM (SELECT unnest(regexp_split_to_array({S}, '\\s+')) AS token FROM uniq) GROUP BY token),
synonyms(token, alternatives) AS (VALUES {_synonym_rows}),
triples AS (
  SELECT 'copy_source' AS model_key, id, {S} AS source, {S} AS prediction, {T} AS reference FROM uniq
  UNION ALL
  SELECT 'clipped', id, {S}, regexp_replace({T}, ' [^ ]*$', ''), {T} FROM uniq)
"""


def _with(body: str, *more: str) -> str:
    return VIEWS + "".join(f", {m}\n" for m in more) + body


# --- near-duplicates: every pair of rows, by brute force -------------------------

SETS = rf"""sets AS MATERIALIZED (
  SELECT id, len(tokens) AS n, tokens
  FROM (SELECT id, list_sort(list_distinct(regexp_split_to_array(lower({S}), '\s'))) AS tokens FROM {{rows}}))"""


def _similar(t: float) -> str:
    shared = "len(list_intersect(a.tokens, b.tokens))"
    return (
        f"least(a.n, b.n) >= {t} * greatest(a.n, b.n) - 1e-6"
        f" AND {shared} / (a.n + b.n - {shared})::DOUBLE >= {t}::DOUBLE"
    )


def _near_dup(t: float, rows: str = "uniq") -> str:
    return _with(
        f"""SELECT sl, id, {S}, {T} FROM uniq
        WHERE id NOT IN (SELECT b.id FROM sets a JOIN sets b ON a.id < b.id AND {_similar(t)})""",
        SETS.format(rows=rows),
    )


def _near_dup_lsh(t: float) -> str:
    bands, rows = banding(t)
    draws = minhash_draws(bands * rows)
    values = ", ".join(f"list_min(list_transform(numbers, lambda x: (x * {a} + {b}) % {PRIME}))" for a, b in draws)
    return _with(
        f"""SELECT sl, id, {S}, {T} FROM uniq WHERE id NOT IN (
          SELECT b.id FROM sets a JOIN sets b ON a.id < b.id AND a.tokens = b.tokens
          UNION ALL
          SELECT b.id FROM (SELECT DISTINCT x.id AS low, y.id AS high FROM keys x JOIN keys y
              ON x.band = y.band AND x.key = y.key AND x.id < y.id) c
            JOIN sets a ON a.id = c.low JOIN sets b ON b.id = c.high WHERE {_similar(t)})""",
        SETS.format(rows="uniq"),
        f"""hashed AS MATERIALIZED (SELECT id, [{values}] AS h FROM (
          SELECT id, list_transform(tokens, lambda t: concat('0x', substr(md5(t), 1, 7))::BIGINT) AS numbers FROM sets))""",
        f"""keys AS MATERIALIZED (SELECT id, band, h[band * {rows} + 1 : band * {rows} + {rows}] AS key
          FROM (SELECT id, h, unnest(range({bands})) AS band FROM hashed))""",
    )


def _links(t: float) -> str:
    shared = "len(list_intersect(a.tokens, b.tokens))"
    every_pair = _with(
        """SELECT sets.id, c.class_id, coalesce(l.n, 0)::BIGINT + reps.copies - 1 AS n_links,
          CASE WHEN reps.copies > 1 THEN 0::DOUBLE ELSE l.dist END AS jaccard_dist
        FROM sets JOIN reps ON sets.tokens = reps.tokens
        JOIN (SELECT id, min(root) AS class_id FROM reach GROUP BY id) c ON c.id = reps.id
        LEFT JOIN (SELECT a, sum(copies) AS n, min(dist) AS dist FROM linked GROUP BY a) l ON l.a = reps.id""",
        SETS.format(rows="uniq"),
        """reps AS MATERIALIZED (SELECT min(id) AS id, count(*) AS copies, any_value(n) AS n, tokens
          FROM sets GROUP BY tokens)""",
        f"""linked AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.copies,
            1 - {shared} / (a.n + b.n - {shared})::DOUBLE AS dist
          FROM reps a JOIN reps b ON a.id <> b.id AND {_similar(t)})""",
        """reach(id, root) AS (SELECT id, id FROM reps
          UNION SELECT linked.b, reach.root FROM reach JOIN linked ON linked.a = reach.id)""",
    )
    return every_pair.replace("WITH", "WITH RECURSIVE", 1)


# --- profiles ----------------------------------------------------------------------


def _profile(rows: str, stage: str | None = None) -> str:
    verdict = ""
    if stage == "raw":
        verdict = ", 'raw' AS stage, count(*) > 0 AS valid"
    if stage == "clean":
        verdict = f", 'clean' AS stage, count(*) > 0 AND count({S}) = count(*) AND count({T}) = count(*) AS valid"
    return _with(
        f"""SELECT count(*) AS total_rows,
          count(*) FILTER ({S} IS NULL) AS {S}_nulls, count(*) FILTER ({T} IS NULL) AS {T}_nulls,
          count(*) FILTER (id IS NULL) AS id_nulls,
          (SELECT count(*) FROM (SELECT id FROM {rows} GROUP BY id HAVING count(*) > 1)) AS duplicate_ids,
          coalesce(avg(CASE WHEN regexp_matches({S}, '{SCRIPT}') THEN 1.0 ELSE 0.0 END), 0)::DOUBLE AS script_coverage
          {verdict} FROM {rows}"""
    )


MEANS = ", ".join(
    f"round(avg({c}), 6) AS {c}_mean" for c in ("src_len", "tgt_len", "len_ratio", "word_overlap")
)

HISTOGRAM = _with(
    """SELECT g."column", g.bin, round(g.bin_low, 9) AS bin_low, round(g.bin_high, 9) AS bin_high,
      count(v.value) AS "count"
    FROM grid g LEFT JOIN vals v ON v."column" = g."column" AND v.value >= g.bin_low
      AND (v.value < g.bin_high OR (g.bin = 49 AND v.value <= g.bin_high))
    GROUP BY ALL""",
    "vals AS MATERIALIZED ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c}::DOUBLE AS value FROM feat"""
        for c in ("src_len", "tgt_len", "len_ratio", "word_overlap")
    )
    + ")",
    """limits AS (SELECT "column",
        CASE WHEN min(value) = max(value) THEN min(value) - 0.5::DOUBLE ELSE min(value) END AS lo,
        CASE WHEN min(value) = max(value) THEN max(value) + 0.5::DOUBLE ELSE max(value) END AS hi
      FROM vals GROUP BY "column")""",
    """grid AS (SELECT "column", b::INTEGER AS bin, lo + b * ((hi - lo) / 50) AS bin_low,
        CASE WHEN b = 49 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 50) END AS bin_high
      FROM limits, range(50) r(b))""",
)

# --- augmentation --------------------------------------------------------------------


def _replaced(tokens: str, p: float) -> str:
    choice = _u("sl", "choice", "i - 1")
    return f"""SELECT sl, list(CASE WHEN {_u("sl", "synonym", "i - 1")} < {p}
          THEN coalesce(alts[floor({choice} * len(alts))::INTEGER + 1], t) ELSE t END ORDER BY i) AS tokens
        FROM (SELECT x.sl, x.i, x.t, y.alternatives AS alts
              FROM (SELECT sl, unnest({tokens}) AS t, generate_subscripts({tokens}, 1) AS i FROM {{rows}}) x
              LEFT JOIN synonyms y ON y.token = x.t)
        GROUP BY sl"""


def _swapped(tokens: str, p: float) -> str:
    at = f"(floor({_u('sl', 'swap_at')} * (len({tokens}) - 1))::INTEGER + 1)"
    return f"""CASE WHEN len({tokens}) >= 2 AND {_u("sl", "swap")} < {p}
      THEN list_concat({tokens}[1:{at} - 1], [{tokens}[{at} + 1], {tokens}[{at}]], {tokens}[{at} + 2:])
      ELSE {tokens} END"""


def _shortened(tokens: str, p: float, least: int = 3) -> str:
    at = f"(floor({_u('sl', 'delete_at')} * len({tokens}))::INTEGER + 1)"
    return f"""CASE WHEN len({tokens}) > {least} AND {_u("sl", "delete")} < {p}
      THEN list_concat({tokens}[1:{at} - 1], {tokens}[{at} + 1:]) ELSE {tokens} END"""


def _augmented(rows: str) -> tuple[str, ...]:
    return (
        f"cut AS (SELECT sl, {_words(S)} AS tokens FROM {rows})",
        f"replaced AS ({_replaced('tokens', 0.3).format(rows='cut')})",
        f"swapped AS (SELECT sl, {_swapped('tokens', 0.5)} AS tokens FROM replaced)",
        f"shortened AS (SELECT sl, {_shortened('tokens', 0.5)} AS tokens FROM swapped)",
        f"""augmented AS (SELECT r.* REPLACE (CASE WHEN len({_words("r." + S)}) >= 3
            THEN array_to_string(s.tokens, ' ') ELSE r.{S} END AS {S})
          FROM {rows} r LEFT JOIN shortened s ON s.sl = r.sl)""",
    )


# --- encoding --------------------------------------------------------------------------


def _vocab(rows: str, size: int = 2000) -> str:
    return f"""vocab AS MATERIALIZED (
      SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS token_id, n AS "count"
      FROM (SELECT token, count(*) AS n FROM
              (SELECT unnest({_words(S)}) AS token FROM {rows}
               UNION ALL SELECT unnest({_words(T)}) FROM {rows})
            WHERE token <> 'paraphrase:' GROUP BY token ORDER BY n DESC, token LIMIT {size}))"""


ENCODED_COLUMNS = """array_to_string(list_concat(i.ids, list_transform(range(48 - len(i.ids)), lambda x: 0)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(i.ids, lambda x: 1), list_transform(range(48 - len(i.ids)), lambda x: 0)), ' ') AS attention_mask,
  array_to_string(list_concat(t.ids, list_transform(range(40 - len(t.ids)), lambda x: 0)), ' ') AS labels"""


def _ids(name: str, text: str, length: int, rows: str) -> str:
    return f"""{name} AS (
      SELECT sl, list(coalesce(CASE WHEN x.token = 'paraphrase:' THEN 2 ELSE v.token_id END, 1) ORDER BY pos) AS ids
      FROM (SELECT sl, unnest(w) AS token, generate_subscripts(w, 1) AS pos
            FROM (SELECT sl, {_words(text)}[1:{length}] AS w FROM {rows})) x
      LEFT JOIN vocab v ON v.token = x.token GROUP BY sl)"""


def _encodings(rows: str) -> tuple[str, ...]:
    return (
        _ids("plain", S, 48, rows),
        _ids("prefixed", f"concat('paraphrase: ', {S})", 48, rows),
        _ids("targets", T, 40, rows),
    )


def _encode_models(rows: str, split_of: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{key}' AS model_key, d.split, c.sl, c.id, {code} AS src_lang, {code} AS tgt_lang, {ENCODED_COLUMNS}
        FROM {rows} c JOIN {split_of} d ON d.sl = c.sl JOIN {ids} i ON i.sl = c.sl JOIN targets t ON t.sl = c.sl"""
        for key, ids, code in (("mt5", "prefixed", "NULL"), ("mbart", "plain", "'bn_IN'"))
    )


# --- scores ----------------------------------------------------------------------------


def _13a(c: str) -> str:
    for pattern, to in (
        ("<skipped>", ""),
        (r"-\n", ""),
        (r"\n", " "),
        ("&quot;", '"'),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    c = f"concat(' ', {c}, ' ')"
    for pattern, to in (
        (r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return _words(c)


def _gram_counts(side: str) -> str:
    return f"""{side}_grams AS (
      SELECT model_key, id, n, gram, count(*) AS c FROM (
        SELECT model_key, id, n, unnest(list_transform(range(1, len({side}) - n + 2),
               lambda i: array_to_string({side}[i:i + n - 1], ' '))) AS gram
        FROM toks, (VALUES (1), (2), (3), (4)) o(n)) GROUP BY ALL)"""


BLEU_PARTS = (
    f"toks AS MATERIALIZED (SELECT model_key, id, {_13a('prediction')} AS p, {_13a('reference')} AS r FROM triples)",
    _gram_counts("p"),
    _gram_counts("r"),
    """hits AS (SELECT model_key, n, sum(least(p.c, r.c)) AS m
      FROM p_grams p JOIN r_grams r USING (model_key, id, n, gram) GROUP BY ALL)""",
    """lens AS (SELECT model_key, sum(len(p))::BIGINT AS sys_len, sum(len(r))::BIGINT AS ref_len,
      """
    + ", ".join(f"sum(greatest(len(p) - {n - 1}, 0))::BIGINT AS total_{n}" for n in (1, 2, 3, 4))
    + " FROM toks GROUP BY model_key)",
    """bleu_sums AS (SELECT lens.*, """
    + ", ".join(
        f"coalesce((SELECT m FROM hits h WHERE h.model_key = lens.model_key AND h.n = {n}), 0)::BIGINT AS match_{n}"
        for n in (1, 2, 3, 4)
    )
    + " FROM lens)",
    # Both runs match at every order, so no order needs smoothing here.
    """bleu AS (SELECT *, round(100 * exp(least(0, 1 - ref_len / sys_len::DOUBLE))
      * exp((ln(match_1 / total_1::DOUBLE) + ln(match_2 / total_2::DOUBLE)
           + ln(match_3 / total_3::DOUBLE) + ln(match_4 / total_4::DOUBLE)) / 4), 6) AS "BLEU" FROM bleu_sums)""",
)


def _rouge(name: str, kept: str) -> tuple[str, ...]:
    """Longest common subsequence as a longest increasing run of match positions:
    each prediction token lists its reference positions downwards, and patience
    sorting keeps the smallest end of every run length."""

    def tok(c):
        return f"list_filter(regexp_split_to_array(lower({c}), '{kept}'), lambda t: t <> '')"

    return (
        f"{name}_toks AS MATERIALIZED (SELECT model_key, id, {tok('prediction')} AS p, {tok('reference')} AS r FROM triples)",
        f"""{name}_hits AS MATERIALIZED (
          SELECT a.model_key, a.id, list([b.j] ORDER BY a.i, b.j DESC) AS steps
          FROM (SELECT model_key, id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM {name}_toks) a
          JOIN (SELECT model_key, id, unnest(r) AS t, generate_subscripts(r, 1) AS j FROM {name}_toks) b
            ON a.model_key = b.model_key AND a.id = b.id AND a.t = b.t
          GROUP BY a.model_key, a.id)""",
        f"""{name}_lcs AS MATERIALIZED (
          SELECT model_key, id, len(list_reduce(steps, lambda ends, x: list_concat(
              list_filter(ends, lambda e: e < x[1]), x, ends[len(list_filter(ends, lambda e: e < x[1])) + 2:]))) AS lcs
          FROM {name}_hits)""",
        f"""{name} AS (SELECT t.model_key, round(avg(CASE WHEN coalesce(lcs, 0) = 0 THEN 0::DOUBLE
            ELSE 2 * (lcs / len(p)::DOUBLE) * (lcs / len(r)::DOUBLE)
               / (lcs / len(p)::DOUBLE + lcs / len(r)::DOUBLE) END), 6) AS "ROUGE-L"
          FROM {name}_toks t LEFT JOIN {name}_lcs l ON l.model_key = t.model_key AND l.id = t.id GROUP BY t.model_key)""",
    )


UNICODE_ROUGE = _rouge("rouge", r"[^\p{L}\p{M}\p{N}]+")
ASCII_ROUGE = _rouge("rouge", "[^a-z0-9]+")

DISTINCT = f"""dist AS (SELECT model_key,
    round(sum(u1) / greatest(sum(g1), 1)::DOUBLE, 6) AS "Distinct-1",
    round(sum(u2) / greatest(sum(g2), 1)::DOUBLE, 6) AS "Distinct-2"
  FROM (SELECT model_key, len(list_distinct(w)) AS u1, len(w) AS g1, len(list_distinct(b)) AS u2, len(b) AS g2
        FROM (SELECT model_key, w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) AS b
              FROM (SELECT model_key, {_words("prediction")} AS w FROM triples)))
  GROUP BY model_key)"""

_offsets = ", ".join(f"('{m}', {o})" for m, o in RUNS.items())
VECTORS = f"""vec_pairs AS (
  SELECT m.model_key, a.vec_id AS pair_id, a.embedding::DOUBLE[] AS s, b.embedding::DOUBLE[] AS p
  FROM (VALUES {_offsets}) m(model_key, shift) CROSS JOIN embeddings a
  JOIN embeddings b ON b.vec_id = a.vec_id + m.shift)"""
SEMSIM = f"""semsim AS (SELECT model_key, round(avg(list_cosine_similarity(s, p)), 6) AS similarity,
    2 * ((SELECT count(*) FROM embeddings) - count(*)) AS unmatched
  FROM vec_pairs GROUP BY model_key)"""
GREEDY = """cosines AS (
  SELECT model_key, pair_id, i, j,
         list_cosine_similarity(p[i * 8 + 1:i * 8 + 8], s[j * 8 + 1:j * 8 + 8]) AS c
  FROM vec_pairs, range(8) a(i), range(8) b(j)),
greedy AS (
  SELECT model_key, round(avg(2 * prec * rec / (prec + rec)), 6) AS "BERTScore" FROM (
    SELECT model_key, pair_id, prec, rec
    FROM (SELECT model_key, pair_id, avg(best) AS prec
          FROM (SELECT model_key, pair_id, i, max(c) AS best FROM cosines GROUP BY ALL) GROUP BY ALL)
    JOIN (SELECT model_key, pair_id, avg(best) AS rec
          FROM (SELECT model_key, pair_id, j, max(c) AS best FROM cosines GROUP BY ALL) GROUP BY ALL)
      USING (model_key, pair_id)) GROUP BY model_key)"""

SCORE_PARTS = (*BLEU_PARTS, *UNICODE_ROUGE, DISTINCT, VECTORS, SEMSIM, GREEDY)
SCORES = """scores AS (
  SELECT model_key, concat(model_key, '-run') AS model_name, "BLEU", "ROUGE-L", "BERTScore",
         "Distinct-1", "Distinct-2", similarity AS semsim_mpnet
  FROM bleu JOIN rouge USING (model_key) JOIN dist USING (model_key)
    JOIN greedy USING (model_key) JOIN semsim USING (model_key))"""


SCORED = "SELECT scores.*, unmatched AS semsim_mpnet_unmatched FROM scores JOIN semsim USING (model_key)"


def _scores(body: str) -> str:
    return _with(body, *SCORE_PARTS, SCORES)


LOG = "(SELECT event_type AS run, event_id AS step, value AS loss FROM events WHERE event_type <> 'error')"
LENGTHS_5_40 = f"{_count(S)} BETWEEN 5 AND 40 AND {_count(T)} BETWEEN 5 AND 40"
TRAIN = "train AS (SELECT u.* FROM uniq u JOIN dealt d ON d.sl = u.sl WHERE split = 'train')"
ROWS = f"sl, id, {S}, {T}"

ORACLES: dict[str, str] = {
    "read_pairs": _with(f"SELECT {ROWS} FROM pairs"),
    "dev_subset": _with(f"SELECT {ROWS} FROM pairs ORDER BY sl, id LIMIT 200"),
    "write_parquet": _with(f"SELECT {ROWS} FROM conv"),
    "read_parquet": _with(f"SELECT {ROWS} FROM pairs"),
    "split_source": _with(f"SELECT {ROWS} FROM train", TRAIN),
    "output_ready": _with("SELECT count(*) AS rows_written, false AS ready_before, true AS ready_after FROM conv"),
    "stage_control": _with(
        """SELECT count(*) AS rows_written, false AS done_before, true AS done_after, false AS done_other_config,
        false AS done_other_output, false AS done_cleared FROM conv"""
    ),
    "json_summary_sink": f"SELECT * REPLACE (round(script_coverage, 6) AS script_coverage) FROM ({_profile('conv', 'raw')})",
    "read_run_metrics": _scores("SELECT * FROM scores"),
    "write_run_summary": _with(
        """SELECT model_key, "BLEU", "ROUGE-L", "Distinct-1", "Distinct-2"
        FROM bleu JOIN rouge USING (model_key) JOIN dist USING (model_key)""",
        *BLEU_PARTS,
        *UNICODE_ROUGE,
        DISTINCT,
    ),
    "read_train_log": f"SELECT * FROM {LOG} ORDER BY run, step",
    "normalize_text": _with(f"SELECT {ROWS} FROM normal"),
    "token_count": _with(f"SELECT sl, {_count(S)} AS src_tokens, {_count(T)} AS tgt_tokens FROM pairs"),
    **{name: _with(f"SELECT sl, {sql} AS {name} FROM clean") for name, sql in FEATURE_SQL.items()},
    "add_features": _with(f"SELECT sl, {', '.join(FEATURE_SQL)} FROM feat"),
    "input_prefix": _with(
        f"""SELECT sl, concat('paraphrase: ', {S}) AS mt5_input, NULL AS mt5_src_lang, NULL AS mt5_tgt_lang,
        {S} AS mbart_input, 'bn_IN' AS mbart_src_lang, 'bn_IN' AS mbart_tgt_lang FROM clean"""
    ),
    "clean_pairs": _with(f"SELECT {ROWS} FROM clean"),
    "drop_null_or_empty": _with(f"SELECT {ROWS} FROM pairs WHERE {S} <> '' AND {T} <> ''"),
    "drop_trivial": _with(
        f"SELECT {ROWS} FROM (SELECT {ROWS} FROM pairs UNION ALL SELECT {ROWS} FROM conv) WHERE {S} <> {T}"
    ),
    "length_band": _with(f"SELECT {ROWS} FROM pairs WHERE {LENGTHS_5_40}"),
    "script_match": _with(f"SELECT {ROWS} FROM pairs WHERE regexp_matches({S}, '{SCRIPT}')"),
    "exact_dedup": _with(f"SELECT {ROWS} FROM uniq"),
    "near_dup_exact": _near_dup(0.95),
    "near_dup_lsh": _near_dup_lsh(0.95),
    "near_dup_exact_t80": _near_dup(0.8),
    "similarity_self_join": _links(0.8),
    "anti_join": _with(
        f"SELECT {ROWS} FROM conv WHERE id NOT IN (SELECT id FROM conv GROUP BY id HAVING count(*) > 1)"
    ),
    "deduplicate": _near_dup(0.95),
    "profile": _profile("conv"),
    "null_counts": _with(
        f"""SELECT count(*) FILTER ({S} IS NULL) AS {S}_nulls, count(*) FILTER ({T} IS NULL) AS {T}_nulls,
        count(*) FILTER (id IS NULL) AS id_nulls FROM pairs"""
    ),
    "duplicate_ids": _with('SELECT id, count(*) AS "count" FROM conv GROUP BY id HAVING count(*) > 1'),
    "script_coverage": _with(
        f"SELECT round(avg(CASE WHEN regexp_matches({S}, '{SCRIPT}') THEN 1 ELSE 0 END), 6) AS script_coverage FROM pairs"
    ),
    "validate_raw": _profile("pairs", "raw"),
    "validate_clean": _profile("uniq", "clean"),
    "eda_summary": _with(f"SELECT count(*) AS total_rows, {MEANS} FROM feat"),
    "numeric_sample": _with(f"SELECT len_ratio AS value FROM feat WHERE {_u('sl', 'sample')} < 0.25"),
    "token_frequency": _with("SELECT * FROM freq"),
    "top_tokens": _with('SELECT * FROM freq ORDER BY "count" DESC, token LIMIT 50'),
    "vocab_size": _with("SELECT count(*) AS vocab_size FROM freq"),
    "vocab_size_merged": _with("SELECT count(*) AS vocab_size, true AS within_2_percent FROM freq"),
    "histogram": HISTOGRAM,
    "split_counts": _with('SELECT split, count(*) AS "count" FROM dealt GROUP BY split'),
    "before_after_counts": _with(
        """SELECT (SELECT count(*) FROM pairs) AS before_clean, (SELECT count(*) FROM clean) AS after_clean,
        (SELECT count(*) FROM uniq) AS after_dedup"""
    ),
    "split_rows": _with("SELECT sl, split FROM dealt"),
    "augment_text": _with(f"SELECT sl, {S} FROM augmented", *_augmented("clean")),
    "synonym_replace": _with(
        "SELECT sl, array_to_string(tokens, ' ') AS edited FROM replaced",
        f"cut AS (SELECT sl, {_words(S)} AS tokens FROM clean)",
        f"replaced AS ({_replaced('tokens', 0.3).format(rows='cut')})",
    ),
    "adjacent_swap": _with(
        f"SELECT sl, array_to_string({_swapped('tokens', 0.5)}, ' ') AS edited FROM cut",
        f"cut AS (SELECT sl, {_words(S)} AS tokens FROM clean)",
    ),
    "random_delete": _with(
        f"SELECT sl, array_to_string({_shortened('tokens', 0.5)}, ' ') AS edited FROM cut",
        f"cut AS (SELECT sl, {_words(S)} AS tokens FROM clean)",
    ),
    "augment_train": _with(
        f"""SELECT sl, {S}, {T}, false AS is_augmented FROM train
        UNION ALL SELECT sl, {S}, {T}, true FROM augmented""",
        TRAIN,
        *_augmented("train"),
    ),
    "build_vocab": _with("SELECT * FROM vocab", _vocab("clean")),
    "encode_pairs": _with(
        f"SELECT c.sl, c.id, {ENCODED_COLUMNS} FROM clean c JOIN prefixed i ON i.sl = c.sl JOIN targets t ON t.sl = c.sl",
        _vocab("clean"),
        *_encodings("clean"),
    ),
    "encode_all": _with(
        _encode_models("clean", "clean_dealt"),
        f"""clean_dealt AS (SELECT sl, CASE WHEN d < 0.8 THEN 'train' WHEN d < 0.9 THEN 'val' ELSE 'test' END AS split
          FROM (SELECT sl, {_u(f"concat_ws('||', {S}, {T})", "split")} AS d FROM clean))""",
        _vocab("clean"),
        *_encodings("clean"),
    ),
    "bleu": _with("SELECT * FROM bleu", *BLEU_PARTS),
    "rouge_l": _with("SELECT * FROM rouge", *UNICODE_ROUGE),
    "rouge_l_ascii": _with("SELECT * FROM rouge", *ASCII_ROUGE),
    "distinct_n": _with("SELECT * FROM dist", DISTINCT),
    "semantic_similarity": _with(
        "SELECT model_key, similarity AS semantic_similarity, unmatched AS semantic_similarity_unmatched FROM semsim",
        VECTORS,
        SEMSIM,
    ),
    "greedy_match_f1": _with("SELECT * FROM greedy", VECTORS, GREEDY),
    "evaluate_run": _scores(f"{SCORED} WHERE model_key = 'clipped'"),
    "evaluate_all": _scores(SCORED),
    "compare_runs": _scores(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, max("{m}") FILTER (model_key = 'copy_source') AS copy_source,
            max("{m}") FILTER (model_key = 'clipped') AS clipped FROM scores"""
            for m in ("BLEU", "ROUGE-L", "BERTScore", "Distinct-1", "Distinct-2", "semsim_mpnet")
        )
    ),
    "loss_curve": f"SELECT * FROM {LOG} ORDER BY run, step",
    "run_preprocess": _with("SELECT f.*, d.split FROM feat f JOIN dealt d ON d.sl = f.sl"),
    "run_eda": _with(
        f"""SELECT count(*) AS total_rows, {MEANS},
        count(*) FILTER ({S} IS NULL) AS {S}_nulls, count(*) FILTER ({T} IS NULL) AS {T}_nulls,
        (SELECT count(*) FROM freq) AS vocab_size,
        (SELECT string_agg(concat(token, ' ', "count"), ', ' ORDER BY "count" DESC, token)
         FROM (SELECT * FROM freq ORDER BY "count" DESC, token LIMIT 50)) AS top_tokens
        FROM feat"""
    ),
    "run_augment": _with(
        f"""SELECT sl, {S}, {T}, {FEATURE_SQL["src_len"]} AS src_len, {OVERLAP} AS word_overlap, is_augmented
        FROM (SELECT sl, {S}, {T}, false AS is_augmented FROM train
              UNION ALL SELECT sl, {S}, {T}, true FROM augmented)""",
        TRAIN,
        *_augmented("train"),
    ),
    "run_encode": _with(
        f"SELECT * FROM ({_encode_models('uniq', 'dealt')})",
        TRAIN,
        _vocab("train"),
        _ids("plain", S, 128, "uniq"),
        _ids("prefixed", f"concat('paraphrase: ', {S})", 128, "uniq"),
        _ids("targets", T, 128, "uniq"),
    ).replace("48 - len", "128 - len").replace("40 - len", "128 - len"),
    "run_evaluate": _scores("SELECT * FROM scores"),
    "run_evaluate_each": _scores("SELECT * FROM scores"),
    "pipeline_status": _with(
        """SELECT stage, CASE WHEN stage = 'preprocess' THEN 'DONE' ELSE 'pending' END AS status, artifact,
          CASE WHEN stage = 'preprocess' THEN 'OK' ELSE 'missing' END AS state,
          CASE WHEN stage = 'preprocess' THEN (SELECT count(*) FROM pairs) END AS rows_in,
          CASE WHEN stage = 'preprocess' THEN (SELECT count(*) FROM clean) END AS rows_clean,
          CASE WHEN stage = 'preprocess' THEN (SELECT count(*) FROM uniq) END AS rows_out
        FROM (VALUES ('preprocess', 'interim/featured.parquet'), ('preprocess', 'processed'),
          ('eda_report', 'reports/eda_stats.json'), ('eda_report', 'reports/histogram.json'),
          ('augmentation', 'augmented/train.parquet'), ('encode', 'encoded'),
          ('evaluate', 'metrics/runs'), ('evaluate', 'metrics/summary.csv')) a(stage, artifact)"""
    ),
}
