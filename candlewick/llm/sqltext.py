"""Oracle SQL of the dealt queries, for those that SQL can say on whole tables."""

from __future__ import annotations

#: CRC-32 of a list of byte values, bit by bit from the lowest.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform({bytes}, lambda b: list_transform(range(8), lambda k: (b >> k) & 1)))),
    lambda c, bit: xor(xor(c, bit) >> 1, 3988292384 * (xor(c, bit) & 1))))"""
DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: unicode(c)::BIGINT)"
#: A letter of U+00C0 to U+00FF is two bytes.
LETTERS = ("flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), "
           "lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(name: str) -> str:
    return f"coalesce(CAST(strlen(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"


def entry(n_chars: str) -> str:
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def climb(name: str, base: str) -> str:
    """Recursive levels of trees: (part, lvl, idx, digest) up to the one node that remains of each part."""
    return f"""{name}(part, lvl, idx, digest, n) AS (
    SELECT part, 0, idx, digest, n FROM {base}
    UNION ALL
    SELECT part, lvl + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY part, lvl, idx // 2, n)"""


def proofs(name: str, levels: str) -> str:
    """Recursive walk from each leaf up: the siblings met, and the digest folded from the changed leaf."""
    return f"""{name}(part, leaf, lvl, idx, n, proof, folded) AS (
    SELECT part, idx, 0, idx, n, '', start FROM {levels}_start
    UNION ALL
    SELECT p.part, p.leaf, p.lvl + 1, p.idx // 2, (p.n + 1) // 2, p.proof || coalesce(s.digest, ''),
           sha256(CASE WHEN p.idx % 2 = 1 THEN s.digest ELSE '' END || p.folded || CASE WHEN p.idx % 2 = 0 THEN coalesce(s.digest, '') ELSE '' END)
    FROM {name} p LEFT JOIN {levels} s ON s.part = p.part AND s.lvl = p.lvl AND s.idx = xor(p.idx, 1) WHERE p.n > 1)"""


MERKLE = f"""WITH RECURSIVE rows_ AS (
    SELECT doc_id, coalesce('=' || lang, '') AS part, {entry('n_chars')} AS digest,
           CASE WHEN {CRC32.format(bytes=DIGITS)} % 7 = 0 THEN {entry('n_chars + 1')} ELSE {entry('n_chars')} END AS start FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM rows_),
{climb('nodes', 'leaves')},
nodes_start AS (SELECT part, idx, n, start FROM leaves),
{proofs('walks', 'nodes')},
parts AS (SELECT part AS name, '' AS part, digest, row_number() OVER (ORDER BY part) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{climb('uppers', 'parts')},
tops AS (SELECT digest AS root FROM uppers WHERE n = 1),
low AS (SELECT part, leaf, proof, folded FROM walks WHERE n = 1),
uppers_start AS (SELECT w.part || ' ' || w.leaf AS part, p.idx, p.n, w.folded AS start, w.proof FROM low w JOIN parts p ON p.name = w.part),
high(part, lvl, idx, n, proof, folded) AS (
    SELECT part, 0, idx, n, proof, start FROM uppers_start
    UNION ALL
    SELECT p.part, p.lvl + 1, p.idx // 2, (p.n + 1) // 2, p.proof || coalesce(s.digest, ''),
           sha256(CASE WHEN p.idx % 2 = 1 THEN s.digest ELSE '' END || p.folded || CASE WHEN p.idx % 2 = 0 THEN coalesce(s.digest, '') ELSE '' END)
    FROM high p LEFT JOIN uppers s ON s.lvl = p.lvl AND s.idx = xor(p.idx, 1) WHERE p.n > 1)
SELECT l.doc_id, l.digest AS leaf, p.digest AS subroot, t.root, sha256(h.proof) AS proof_sha256, h.folded AS folded_root, h.folded = t.root AS verified
FROM leaves l JOIN parts p ON p.name = l.part JOIN high h ON h.n = 1 AND h.part = l.part || ' ' || l.idx CROSS JOIN tops t"""

LINES = f"""WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM texts),
keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
held AS (SELECT key, max(doc_id) AS last FROM keys WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.last AS dropped FROM keys k LEFT JOIN held h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN dropped THEN 1 END) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

VARIANTS = f"""WITH runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, run, count(*) AS n, length(run) AS size FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT *, {CRC32.format(bytes=LETTERS)} AS h FROM counted),
spoiled AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % size AS BIGINT)) || substring(run, CAST(h % size AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS size FROM spoiled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, size, unnest(range(1, size + 1)) AS spot FROM words),
holes AS (SELECT word, n, size, spot, substring(word, 1, spot - 1) || substring(word, spot + 1) AS rest FROM places),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.spot = b.spot AND a.size = b.size AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
formed AS (
    SELECT w.word, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
hops AS (SELECT word, word AS here, form AS next FROM formed UNION ALL SELECT h.word, f.word, f.form FROM hops h JOIN formed f ON f.word = h.next)
SELECT f.word, f.form, h.here AS root, f.n, f.n_near, f.form_n FROM formed f JOIN hops h ON h.word = f.word AND h.next IS NULL"""
VARIANTS = VARIANTS.replace("WITH runs", "WITH RECURSIVE runs", 1)

ORACLES = {"op11_spelling_variants": VARIANTS, "op12_merkle_manifest": MERKLE, "op13_line_dedup": LINES}
