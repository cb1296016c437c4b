"""DuckDB SQL for the operators that SQL can express, over the same whole tables.

Operators 1 and 2 draw from MD5, which both engines have; 4 joins shingles on
their words and follows links; 6 counts lines by their text.
"""

WORDS = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def _draw(seed: str, *parts: str) -> str:
    """The draw of ``common.drawn``: an integer in [0, 2**48) from 12 hex digits of MD5."""
    joined = " || ':' || ".join([f"'{seed}'", *(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)])
    return f"CAST('0x' || substr(md5({joined}), 1, 12) AS BIGINT)"


_UNIT = "281474976710656.0::DOUBLE"
_STRATUM = "CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END"
_LOWER_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 (reflected, polynomial EDB88320) byte by byte: a table of 256 entries from eight steps each.
_CRC_TABLE = """steps AS (
  SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crcs AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8)"""
_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, "
    "[CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]), "
    "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"
)

SHARDING = f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (
  SELECT doc_id, source, {_STRATUM} AS stratum, strlen(coalesce(text, '')) + 1 AS size, {_CRC} AS text_crc32, {_draw("17", "doc_id")} AS h FROM documents, crcs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, text_crc32) AS r, count(*) OVER (PARTITION BY stratum) AS n,
         {_draw("18", "stratum")} / {_UNIT} AS shift FROM docs),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r - shift) / n, stratum, h, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 16 // total AS INTEGER) AS shard,
       p - (((p * 16) // total) * total + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed"""

SEEDS = 16

MIXING = f"""
WITH docs AS (
  SELECT doc_id, source, {_STRATUM} AS stratum, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size, md5(coalesce(text, '')) AS t FROM documents),
sizes AS (SELECT stratum, source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY ALL),
named AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM sizes),
filled AS (
  SELECT *, row_number() OVER w AS nth, sum(most) OVER w - most AS caps_before, sum(weight) OVER () - sum(weight) OVER w + weight AS weights_on
  FROM named WINDOW w AS (ORDER BY most / weight, place)),
levels AS (SELECT *, (wanted - caps_before) / weights_on AS level_here FROM filled),
level AS (SELECT arg_min(level_here, nth) AS level FROM levels WHERE most / weight > level_here),
targets AS (
  SELECT stratum, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM levels LEFT JOIN level ON TRUE),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
tries AS (
  SELECT doc_id, source, stratum, size, source_size, target, k,
         CAST(floor(rate) AS BIGINT) + CASE WHEN {_draw("29", "k", "doc_id", "t")} / {_UNIT} < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM docs JOIN rates USING (stratum), range({SEEDS}) s(k)),
picks AS (
  SELECT stratum, arg_min(k, (miss, k)) AS pick FROM (SELECT stratum, k, abs(sum(size * copies)::DOUBLE - any_value(target)) AS miss FROM tries GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies, source
FROM tries JOIN picks USING (stratum) WHERE k = pick"""

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER_ASCII}, '{WORDS}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(lowest, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS lowest FROM reach GROUP BY ALL) r ON r.doc_id = d.doc_id"""

QUALITY = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (SELECT doc_id, text, i, w[i:i + 7] AS x FROM (SELECT doc_id, text, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
again AS (SELECT doc_id, text, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, text, x) > 1),
repeats AS (SELECT doc_id, text, count(DISTINCT i + k) AS n FROM again, range(8) r(k) GROUP BY ALL),
lines AS (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS raw FROM docs),
filled AS (SELECT doc_id, text, source, raw, lower(trim(regexp_replace(raw, '{SPACES}', ' ', 'g'))) AS line FROM lines WHERE regexp_matches(raw, '{WORDS}')),
doubles AS (SELECT doc_id, text, count(*) - count(DISTINCT raw) AS n FROM filled GROUP BY ALL),
hosts AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL),
frequent AS (
  SELECT f.source, line FROM filled f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  GROUP BY f.source, line, h.n HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.01 * h.n),
counted AS (SELECT f.*, len(regexp_extract_all(f.line, '[^ ]+')) AS n, q.line IS NOT NULL AS is_frequent
            FROM filled f LEFT JOIN frequent q ON f.line = q.line AND f.source IS NOT DISTINCT FROM q.source),
worn AS (SELECT doc_id, text FROM counted GROUP BY ALL HAVING coalesce(sum(n) FILTER (WHERE is_frequent), 0) > (1 - 1.0::DOUBLE / 3) * sum(n)),
figures AS (
  SELECT d.doc_id, d.text, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(doubles.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN doubles ON doubles.doc_id = d.doc_id AND doubles.text = d.text LEFT JOIN repeats ON repeats.doc_id = d.doc_id AND repeats.text = d.text)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND worn.doc_id IS NULL AS kept
FROM figures f LEFT JOIN worn ON worn.doc_id = f.doc_id AND worn.text = f.text"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": SHARDING, "op2_mixing": MIXING, "op4_jaccard": JACCARD, "op6_quality": QUALITY}
