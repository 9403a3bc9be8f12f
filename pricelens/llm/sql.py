"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_URL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
judged AS (
  SELECT p.*, (SELECT arg_max(struct_pack(r := r.rule, v := r.verdict), length(r.rule)) FROM rules r
    WHERE (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)) AS best
  FROM parts p)
SELECT page_id, host, path, best.r AS rule,
  coalesce(best.v, CASE WHEN contains(host, 'spam-farm') OR contains(path, 'spam-farm') OR contains(host, 'cheap-pills') OR contains(path, 'cheap-pills')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
_ASSIGN = f"""(?:{_WORDS})["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]"""
#: Kind, what is found from left to right, what of it counts.
SECRETS = [
    ("assign", _ASSIGN + "+", _ASSIGN + "{8,}"),
    ("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{12,}"),
    ("hex", "[0-9a-f]{32,}", ".*"),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", ".*"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", ".*"),
    ("repository_token", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{16,}"),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("payment_key", "[rs]k_live_[A-Za-z0-9]+", "[rs]k_live_[A-Za-z0-9]{16,}"),
]


def _secrets() -> str:
    found = "\nUNION ALL\n".join(
        f"""SELECT row, {n} AS n, '{kind}' AS kind, pos, hit FROM (
  SELECT row, hit, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT row, unnest(string_split_regex(t, '{find}')) AS gap, unnest(regexp_extract_all(t, '{find}')) AS hit,
               unnest(range(len(string_split_regex(t, '{find}')))) AS k FROM d WHERE regexp_matches(t, '{find}')) u
  WINDOW w AS (PARTITION BY row ORDER BY k)) v
WHERE hit IS NOT NULL AND regexp_full_match(hit, '{keep}')""" for n, (kind, find, keep) in enumerate(SECRETS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
s AS (SELECT row, n, kind, CAST(pos AS BIGINT) AS a, kind || ':' || CAST(pos AS BIGINT) || ':' || (CAST(pos AS BIGINT) + length(hit)) AS span FROM f),
g AS (SELECT row, count_if(n = 0) AS n_assign, count_if(n = 1) AS n_access, count_if(n = 2) AS n_hex,
             string_agg(span, ',' ORDER BY a, n) FILTER (n < 3) AS base, string_agg(span, ',' ORDER BY a, n) AS spans FROM s GROUP BY row)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)"""


def _terms(text: str) -> str:
    folded = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_terms("text")} AS own FROM documents),
k AS (SELECT row, doc_id, len(own) AS n, own FROM d WHERE len(own) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM k),
i AS (SELECT row_number() OVER () AS item, item_id, {_terms("text")} AS own FROM benchmark),
q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(own) AS term FROM i) u GROUP BY item, term),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(own) AS term FROM k) u WHERE term IN (SELECT term FROM q) GROUP BY row, term),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term),
part AS (SELECT tf.row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS c
         FROM tf JOIN df USING (term) JOIN k ON k.row = tf.row, g),
score AS (SELECT item, row, CAST(sum(times * c) AS BIGINT) AS score FROM q JOIN part USING (term) GROUP BY item, row),
ranked AS (SELECT item, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
           FROM score JOIN k USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= 10
"""

#: Levels that the trees of the SQL may have: three to this power leaves a tree.
TREE_LEVELS = 14


def _merkle() -> str:
    """Levels written out: every node with its parent's other children before and behind it, then proofs and folds down them."""
    no_line_ends = "replace(text, chr(10), '')"

    def framed(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"list_reduce(list_prepend(4294967295, {bits}), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)))"
    ctes = [f"d AS (SELECT row_number() OVER () AS row, *, {leaf('text')} AS leaf, doc_id IS NOT NULL AND xor({crc}, 4294967295) % 2 = 0 AS bad FROM documents)",
            f"f AS (SELECT *, CASE WHEN bad THEN {leaf(no_line_ends)} ELSE leaf END AS found FROM d)",
            "s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents) u)",
            "l AS (SELECT f.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS pos FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source)"]

    def grow(name: str, leaves: str) -> None:
        """Levels ``name0`` to ``nameN`` of (tree, pos, h, before, behind, grows), from (tree, pos, h)."""
        ctes.append(f"{name}n0 AS ({leaves})")
        for i in range(TREE_LEVELS):
            run = "PARTITION BY tree, pos // 3 ORDER BY pos"
            ctes.append(f"""{name}{i} AS MATERIALIZED (SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) > 1 AS grows,
  coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM {name}n{i})""")
            ctes.append(f"{name}n{i + 1} AS (SELECT tree, pos // 3 AS pos, CASE WHEN any_value(grows) THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{i} GROUP BY tree, pos // 3)")

    grow("a", "SELECT tree, pos, leaf AS h FROM l")
    grow("b", f"SELECT 0 AS tree, tree AS pos, h FROM an{TREE_LEVELS}")

    ctes.append("w0 AS (SELECT row, tree, pos, found AS folded, '' AS proof FROM l)")
    step = 0
    for name in ("a", "b"):
        if name == "b":
            ctes.append(f"w{step + 1} AS (SELECT row, 0 AS tree, tree AS pos, folded, proof FROM w{step})")
            step += 1
        for i in range(TREE_LEVELS):
            ctes.append(f"""w{step + 1} AS (SELECT row, w.tree, w.pos // 3 AS pos, CASE WHEN grows THEN sha256(before || folded || behind) ELSE folded END AS folded,
  CASE WHEN grows THEN proof || before || behind ELSE proof END AS proof FROM w{step} w JOIN {name}{i} n ON n.tree = w.tree AND n.pos = w.pos)""")
            step += 1
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, t.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM l JOIN w{step} w USING (row) JOIN an{TREE_LEVELS} t ON t.tree = l.tree, bn{TREE_LEVELS} r"""


ORACLE: dict[str, str] = {
    "op9_url_filter": _URL,
    "op11_secret_scan": _secrets(),
    "op12_lexical_search": _SEARCH,
    "op13_merkle_manifest": _merkle(),
}
