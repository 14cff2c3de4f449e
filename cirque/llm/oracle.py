"""SQL for DuckDB that gives the rows of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .rules import METRICS, SCALE, SYMBOLS, RuleParams
from .urls import RULES, TreeParams

#: Digests in base32 from hexadecimal: 20 bits at a time. The smallest page_id of equal payloads is referred to.
WARC = """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
 q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
 SELECT page_id, payload_bytes, array_to_string(flatten(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda s:
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5*i+1 AS BIGINT), 5) AS INTEGER) >> s) & 31), 1)))), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


def url_filter(p: TreeParams = TreeParams()) -> str:
    """Rules by the longest that fits, then the tree level by level over distinct (host, template) rows."""
    by_length = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{q}')" for h, q, _ in by_length]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{q}'" for f, (h, q, _) in zip(fits, by_length)) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, by_length)) + " END"
    number = r"regexp_replace(regexp_replace(s, '^[0-9]+(\.[0-9A-Za-z_]+)?\z', '<n>\1'), '^[0-9a-fA-F-]{16,}\z', '<id>')"
    general = rf"CASE WHEN regexp_matches({number}, '[0-9]') AND regexp_matches({number}, '^[0-9A-Za-z_%~-]{{24,}}\z') THEN '<token>' ELSE {number} END"
    out = [
        f"""u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
        f"v AS (SELECT *, {rule} AS rule, {says} AS says, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {general}) AS segs FROM u)",
        f"base AS (SELECT * EXCLUDE (segs), CASE WHEN len(segs) > {p.depth} THEN segs[1:{p.depth}] || ['**'] ELSE segs END AS template FROM v)",
        "rws AS (SELECT host, template, count(says) AS known, count(*) FILTER (says = 'block') AS bad FROM base GROUP BY ALL)",
        """sc AS (SELECT *, 'h' || host AS scope FROM rws WHERE host <> '' UNION ALL
 SELECT *, 'd' || array_to_string(string_split(host, '.')[-2:], '.') FROM rws WHERE host <> '' UNION ALL SELECT *, 'a' FROM rws WHERE host <> '')""",
        "root AS (SELECT scope, CAST(sum(known) AS BIGINT) AS k, CAST(sum(bad) AS BIGINT) AS b, count(DISTINCT CASE WHEN known > 0 THEN host END) AS h FROM sc GROUP BY scope)",
        f"t0 AS (SELECT sc.*, k, b, h, (b + {p.strength}::DOUBLE * {p.prior}::DOUBLE) / (k + {p.strength}::DOUBLE) AS score, '' AS node FROM sc JOIN root USING (scope))",
    ]
    for i in range(p.depth + 1):
        out += [
            f"o{i} AS (SELECT *, template[{i + 1}] AS seg FROM t{i} WHERE len(template) > {i})",
            f"v{i} AS (SELECT scope, node, seg, count(DISTINCT host) AS seen FROM o{i} GROUP BY ALL)",
            f"f{i} AS (SELECT *, count(*) OVER (PARTITION BY scope, node) AS fan FROM v{i})",
            f"""p{i} AS (SELECT o.*, CASE WHEN CASE WHEN scope LIKE 'h%' THEN fan <= {p.fan_out} ELSE seen >= {p.hosts} END THEN seg ELSE '*' END AS part
 FROM o{i} o JOIN f{i} USING (scope, node, seg))""",
            f"""c{i} AS (SELECT scope, node, part, CAST(sum(known) AS BIGINT) AS ck, CAST(sum(bad) AS BIGINT) AS cb, count(DISTINCT CASE WHEN known > 0 THEN host END) AS ch
 FROM p{i} GROUP BY ALL)""",
            f"w{i} AS (SELECT *, CAST(sum(ck) OVER (PARTITION BY scope, node) AS BIGINT) AS pk, CAST(sum(cb) OVER (PARTITION BY scope, node) AS BIGINT) AS pb FROM c{i})",
            f"x{i} AS (SELECT *, pb / greatest(pk, 1) AS share FROM w{i})",
            f"""b{i} AS (SELECT *, ck > 0 AND pk - ck > 0 AND abs(cb / greatest(ck, 1) - (pb - cb) / greatest(pk - ck, 1))
 <= {p.z}::DOUBLE * sqrt(share * (1 - share) * (1 / greatest(ck, 1) + 1 / greatest(pk - ck, 1))) AS alike FROM x{i})""",
            f"""t{i + 1} AS (SELECT host, template, known, bad, scope, CASE WHEN alike THEN k ELSE ck END AS k, CASE WHEN alike THEN b ELSE cb END AS b,
 CASE WHEN alike THEN h ELSE ch END AS h, CASE WHEN alike THEN score ELSE (cb + {p.strength}::DOUBLE * score) / (ck + {p.strength}::DOUBLE) END AS score,
 node || '/' || CASE WHEN alike THEN '*' ELSE part END AS node FROM p{i} JOIN b{i} USING (scope, node, part)
 UNION ALL BY NAME SELECT host, template, known, bad, scope, k, b, h, score, node FROM t{i} WHERE len(template) <= {i})""",
        ]
    last = f"t{p.depth + 1}"
    out.append(
        f"""j AS (SELECT h.host, h.template, h.node AS leaf, h.k, h.b, d.h >= {p.hosts} OR a.h >= {p.hosts} OR h.k >= {p.support} AS judged, d.h AS dh, d.k AS dk, d.b AS db,
 CASE WHEN a.h >= {p.hosts} THEN a.score ELSE {p.prior}::DOUBLE END AS p0
 FROM (SELECT * FROM {last} WHERE scope LIKE 'h%') h JOIN (SELECT * FROM {last} WHERE scope LIKE 'd%') d USING (host, template) JOIN (SELECT * FROM {last} WHERE scope = 'a') a USING (host, template))"""
    )
    out.append(f"j1 AS (SELECT *, CASE WHEN dh >= {p.hosts} THEN (db + {p.strength}::DOUBLE * p0) / (dk + {p.strength}::DOUBLE) ELSE p0 END AS p1 FROM j)")
    out.append(f"j2 AS (SELECT host, template, leaf, judged, (b + {p.strength}::DOUBLE * p1) / (k + {p.strength}::DOUBLE) AS purity FROM j1)")
    verdict = f"coalesce(says, CASE WHEN judged AND purity >= {p.purity} THEN 'block' ELSE 'allow' END)"
    return "WITH " + ",\n".join(out) + f"\nSELECT page_id, host, path, rule, {verdict} AS verdict, leaf, purity FROM base LEFT JOIN j2 USING (host, template)"


def quality_rules(p: RuleParams = RuleParams()) -> str:
    """Base counts (repeated windows by their words, not by hashes), the sketches as bins, and the fences from these."""
    space = "[ \\x09-\\x0D]"
    shares = ", ".join(f"({count} << {SCALE}) // greatest({of}, 1) AS {m}" for m, (count, of) in METRICS.items())
    metrics = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM c WHERE NOT base_failed" for m in METRICS)
    out = [
        f"""d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{space}+', '', 'g') AS sq,
 list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w FROM documents)""",
        "win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))",
        "again AS (SELECT r, unnest(range(i, i + 8)) AS j FROM win JOIN (SELECT r, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (r, g))",
        "rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM again GROUP BY r)",
        f"""l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
 WHERE regexp_matches(x, '[^ \\x09-\\x0D]') GROUP BY r)""",
        f"""c0 AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(sq)::BIGINT AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', ''))::BIGINT AS n_symbols,
 length(sq) - length(regexp_replace(sq, '\\p{{Lu}}+', '', 'g'))::BIGINT AS n_upper, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN l USING (r) LEFT JOIN rep USING (r))""",
        f"c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {shares} FROM c0)",
        f"v AS ({metrics})",
        f"b0 AS (SELECT *, greatest(0, length(bin(v)) - {p.bits}) AS k FROM v)",
        "bins AS (SELECT lang, source, metric, (((v >> k) + 1) << k) - 1 AS top, count(*) AS n FROM b0 GROUP BY ALL)",
    ]
    for name, keys in (("own", "lang, source, metric"), ("lang", "lang, metric"), ("whole", "metric")):
        out += [
            f"{name}0 AS (SELECT {keys}, top, sum(n) AS n FROM bins GROUP BY ALL)",
            f"""{name}1 AS (SELECT {keys}, top, sum(n) OVER (PARTITION BY {keys} ORDER BY top) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total,
 sum(n * top) OVER (PARTITION BY {keys} ORDER BY top) AS s0, sum(n * top) OVER (PARTITION BY {keys}) AS s, sum(n * top * top) OVER (PARTITION BY {keys})::DOUBLE AS q FROM {name}0)""",
            f"""{name}2 AS (SELECT *, CASE WHEN upto <= total - {p.few} THEN s0::DOUBLE / upto::DOUBLE - (s - s0)::DOUBLE / (total - upto)::DOUBLE END AS gap FROM {name}1)""",
            f"""{name}3 AS (SELECT {keys}, max(total)::BIGINT AS n, min(top) FILTER (1000 * upto >= 250 * total) AS q1, min(top) FILTER (1000 * upto >= 750 * total) AS q3,
 min(top) FILTER (1000 * upto >= {1000 - p.tail} * total) AS far, max(gap * gap * (upto::DOUBLE / total::DOUBLE * (total - upto)::DOUBLE)) AS best, max(q - s::DOUBLE * s::DOUBLE / total::DOUBLE) AS whole
 FROM {name}2 GROUP BY {keys})""",
            f"""{name}4 AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, min(top) AS cut FROM {name}2 a JOIN {name}3 b
 ON {' AND '.join(f'a.{k} IS NOT DISTINCT FROM b.{k}' for k in keys.split(', '))} WHERE gap * gap * (upto::DOUBLE / total::DOUBLE * (total - upto)::DOUBLE) = best GROUP BY ALL)""",
            f"""{name} AS (SELECT a.*, CASE WHEN q3 > q1 THEN q3 + {p.spread} * (q3 - q1) WHEN best >= {p.clear}::DOUBLE * whole THEN cut ELSE far END::BIGINT AS fence
 FROM {name}3 a LEFT JOIN {name}4 b ON {' AND '.join(f'a.{k} IS NOT DISTINCT FROM b.{k}' for k in keys.split(', '))})""",
        ]
    out += [
        f"ld AS (SELECT lang.lang, metric, (lang.n * lang.fence + {p.shrink} * whole.fence) // (lang.n + {p.shrink}) AS fence FROM lang JOIN whole USING (metric))",
        f"""f AS (SELECT own.lang, own.source, own.metric, (own.n * own.fence + {p.shrink} * ld.fence) // (own.n + {p.shrink}) AS fence
 FROM own JOIN ld ON own.lang IS NOT DISTINCT FROM ld.lang AND own.metric = ld.metric)""",
    ]
    over = " OR ".join(f"{m} > (SELECT any_value(fence) FROM f WHERE f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source AND metric = '{m}')" for m in METRICS)
    return "WITH " + ",\n".join(out) + f"""\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({over}, false) AS kept FROM c"""
