"""DuckDB SQL of the operators that SQL can express."""

CHAT = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(text, '(\\\\*)(<\\|turn\\|>|<\\|text\\|>|<\\|end\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<\\|startoftext\\|>)', '\\\\\\1\\2', 'g'))
         + length(regexp_replace(replace(replace(role, '~', '~0'), chr(10), '~1'), '(\\\\*)(<\\|turn\\|>|<\\|text\\|>|<\\|end\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<\\|startoftext\\|>)', '\\\\\\1\\2', 'g')) AS escaped_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(escaped_chars + 27)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

#: CRC-32 byte by byte: `crc` is the table of its 256 steps, `CRC` the value of an ASCII text.
CRC_TABLE = """
crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab
)"""
CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"

_BEST = "list_sort([{0}])[1]"
_ADD = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}'}}"


def _closed(s: str, y: str, u: str, r: str) -> str:
    """States after a row, then after the cheapest insertions."""
    return f"""
  SELECT conv_id, pos, s, y, u2 AS u, {_BEST.format("r, " + _ADD.format("u2", 2, "I"))} AS r FROM (
    SELECT *, {_BEST.format("u, " + ", ".join(_ADD.format(x, 2, "I") for x in "syr"))} AS u2 FROM (
      SELECT conv_id, pos, {s} AS s, {y} AS y, {u} AS u, {r} AS r"""


def _edit(state: str, moves: list[tuple[str, str, str]]) -> str:
    """The best way into a state: deleting the row, or one of the moves (from, condition, letter)."""
    ways = [_ADD.format("p." + state, 3, "D")]
    for origin, condition, letter in moves:
        cost = {"K": "x.late", "R": "2 + x.late"}[letter]
        ways.append(f"{{'c': CASE WHEN NOT x.gone AND {condition} THEN p.{origin}.c + {cost} ELSE 1000000000 END, 'a': p.{origin}.a || '{letter}'}}")
    return _BEST.format(", ".join(ways))


_USER = [(o, c, k) for o in "syr" for c, k in (("x.initial = 'u'", "K"), ("true", "R"))]
REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fates, range(2) copies(k) WHERE fate <> 0 AND (k = 0 OR fate = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS initial
  FROM damaged
), known AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM placed
), rows AS (
  SELECT conv_id, turn, role, text, pos, initial, bare = '' AS blank, bare <> '' AND seen > 1 AS duplicate,
    bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM known
), edits AS (SELECT *, blank OR duplicate AS gone, truncated::INT AS late FROM rows
), state AS ({_closed("{'c': 0::BIGINT, 'a': ''}", *["{'c': 1000000000::BIGINT, 'a': ''}"] * 3)} FROM (SELECT DISTINCT conv_id, 0::BIGINT AS pos FROM rows)))
  UNION ALL {_closed(_edit("s", []), _edit("y", [("s", "x.initial = 's'", "K")]), _edit("u", _USER), _edit("r", [("u", "x.initial = 'a'", "K"), ("u", "true", "R")])).replace("SELECT conv_id, pos, list_sort", "SELECT x.conv_id, x.pos, list_sort")}
      FROM state p JOIN edits x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.pos = p.pos + 1))
), ends AS (
  SELECT conv_id, list_sort([s, r])[1] AS best FROM state QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS i FROM ends WHERE best.a <> ''
), walked AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), turns AS (
  SELECT k.conv_id, k.i, k.letter, k.place, x.role, x.text,
    max(CASE WHEN k.place = 1 AND k.letter = 'K' AND x.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY k.conv_id) AS shift
  FROM walked k LEFT JOIN edits x ON x.conv_id IS NOT DISTINCT FROM k.conv_id AND x.pos = k.pos AND k.letter <> 'I'
  WHERE k.letter <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS sha
  FROM turns GROUP BY conv_id
), numbers AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM rows GROUP BY conv_id
)
SELECT c.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
  coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit, coalesce(r.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN numbers n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY source
), capped AS (
  SELECT *, source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS everything, sum(weight) OVER ()::BIGINT AS weights,
    coalesce(sum(source_size * 3) OVER w, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
  FROM sources WINDOW w AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, cap::DOUBLE * (weights - weight_before) <= (everything - cap_before)::DOUBLE * weight AS full_ FROM capped
), levels AS (
  SELECT *, (everything - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ())::DOUBLE / nullif((weights - sum(CASE WHEN full_ THEN weight ELSE 0 END) OVER ())::DOUBLE, 0) AS level FROM marked
), targets AS (
  SELECT source, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE weight * level END AS target FROM levels
), drawn AS (
  SELECT d.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
    ('0x' || substr(md5('12:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || row_number() OVER (PARTITION BY d.doc_id ORDER BY d.source NULLS LAST, d.size)), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target, ((floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM drawn
"""

TRIE = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC.format(text="conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc
), pieces AS (
  SELECT i.conv_id, t.d, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.d <= i.h
  UNION ALL SELECT i.conv_id, t.d, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.d > i.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS d, length(text) AS chars,
    sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY d) OVER w) AS node
  FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY d)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids
), nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY d, node
), edges AS (
  SELECT DISTINCT p.d, p.node, above.node AS parent FROM paths p JOIN paths above ON above.conv_id = p.conv_id AND above.d = p.d - 1
), children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM edges GROUP BY ALL
), under AS (
  SELECT DISTINCT a.d, a.node, b.d AS below_d, b.node AS below FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.d >= a.d
), sums AS (
  SELECT u.d, u.node, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM under u JOIN nodes n ON n.d = u.below_d AND n.node = u.below LEFT JOIN children c ON c.d = u.below_d AND c.node = u.below GROUP BY ALL
), ends AS (
  SELECT node, d, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
  FROM (SELECT conv_id, d, node FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.node = n.node
LEFT JOIN edges g ON g.d = n.d AND g.node = n.node LEFT JOIN nodes up ON up.d = g.d - 1 AND up.node = g.parent
LEFT JOIN children c ON c.d = n.d AND c.node = n.node LEFT JOIN ends e ON e.d = n.d AND e.node = n.node
"""

ORACLES = {"op2_chat_formatting": CHAT, "op11_conversation_repair": REPAIR, "op12_source_mixing": MIX, "op13_prefix_trie": TRIE}
