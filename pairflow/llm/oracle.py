"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, name: str) -> str:
    """(key, s) for the distinct five-word shingles of a table's texts."""
    return f"""
 {name}_w AS (SELECT {key}, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') w FROM {table}),
 {name} AS (SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
   lambda i: array_to_string(w[i:i+4], ' '))) s FROM {name}_w WHERE len(w) > 0)"""


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_BLOCKED = " OR ".join(f"(host = '{n}.example.{e}' OR ends_with(host, '.{n}.example.{e}'))" for e in ("com", "net", "org")
                       for n in ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"))

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::ubigint) ELSE s >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::ubigint)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {codes}), lambda a, b: {byte}), 4294967295::ubigint)"


ORACLE: dict[str, str] = {
    "op1_decontamination": f"""WITH {_shingles('documents', 'doc_id', 'd')}, {_shingles('benchmark', 'item_id', 'b')},
 n AS (SELECT item_id, count(*) n_item FROM b GROUP BY 1),
 h AS (SELECT doc_id, item_id, count(*) n_shared FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item::double AS containment
FROM h JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item""",
    "op3_ngram_jaccard_join": f"""WITH RECURSIVE {_shingles('documents', 'doc_id', 'd')},
 n AS (SELECT doc_id, count(*) n FROM d GROUP BY 1),
 p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM d x JOIN d y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
 r(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, b FROM r JOIN e ON e.a = r.node)
SELECT doc_id, coalesce(any_value(n.n), 0)::bigint AS n_shingles, min(r.node) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.id = documents.doc_id GROUP BY doc_id""",
    "op5_url_filter": f"""WITH h AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path FROM pages),
 r AS (SELECT *, CASE WHEN {_fits('www.example.com', '/en/')} THEN 'www.example.com/en/' WHEN {_fits('example.com', '/en/')}
  THEN 'example.com/en/' WHEN {_fits('net', '/es/')} THEN 'net/es/' WHEN {_fits('net', '/fr/')} THEN 'net/fr/'
  WHEN {_fits('com', '/')} THEN 'com/' END AS "rule" FROM h)
SELECT page_id, host, path, "rule", CASE WHEN "rule" IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN "rule" IS NOT NULL THEN 'block'
  WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op11_prefix_trie": f"""WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) t
   FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
 f AS (SELECT o.c, coalesce(b.t, []) b, o.t, ({_crc32('o.c::varchar')} % 4)::bigint h FROM o LEFT JOIN o b ON b.c = o.c - o.c % 20),
 s AS (SELECT c, list_concat(b[1:h], t[h+1:]) s FROM f),
 p AS (SELECT c, len(s) n, d, s[1:d] k FROM (SELECT *, unnest(range(0, len(s) + 1)) d FROM s)),
 n AS (SELECT k, d, min(c) c, count(*) n,
   sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (WHERE n = d), '')) e FROM p GROUP BY 1, 2),
 m AS (SELECT a.*, b.c AS parent, (a.n - 1) * CASE WHEN a.d = 0 THEN 0
   ELSE len(regexp_extract_all(a.k[a.d].t, '[^\\x20\\x09-\\x0D]+')) END v,
   (SELECT count(*) FROM n x WHERE x.d = a.d + 1 AND x.k[1:a.d] = a.k) q
   FROM n a LEFT JOIN n b ON b.d = a.d - 1 AND b.k = a.k[1:a.d-1])
SELECT a.c AS conv_id, a.d AS depth, any_value(a.parent) AS parent_conv_id, any_value(a.n) AS n_convs,
 any_value(a.q) AS n_children, count(*) FILTER (WHERE x.q = 0) AS n_leaves, sum(x.v)::bigint AS saved_tokens,
 any_value(a.e) AS ends_sha256
FROM m a JOIN m x ON x.d >= a.d AND x.k[1:a.d] = a.k GROUP BY a.c, a.d, a.k""",
}
