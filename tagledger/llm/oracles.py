"""DuckDB SQL of the registered queries that SQL can express. The others hash, draw, learn or
follow state, and are tested against plain Python instead."""

from __future__ import annotations

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIPPED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLES: dict[str, str] = {
    "op9_lines": f"""
WITH pieces AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM pieces),
keyed AS (SELECT *, {_LOWER.format(x=_STRIPPED)} AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
             GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, coalesce(r.last <> k.doc_id, false) AS dropped FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op12_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array({_LOWER.format(x="coalesce(text, '')")}, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece
                FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
runs AS (SELECT lang, size, array_to_string(words[first:first + size - 1], ' ') AS phrase
         FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS first FROM worded, range(1, 5) AS sizes(size))),
counts AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(words)) AS n FROM worded GROUP BY lang),
phrases AS (SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE size > 1),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
         FROM (SELECT *, unnest(range(1, size)) AS k FROM phrases)),
valued AS (SELECT c.*, x.f AS l, y.f AS r, (2000000 * a) // (x.f + y.f) AS score FROM cuts c
           JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (SELECT lang, f, array_to_string(words[first:first + part - 1], ' ') AS phrase
               FROM (SELECT *, unnest(range(1, size - part + 2)) AS first
                     FROM (SELECT *, unnest(range(2, size)) AS part FROM phrases))),
longer AS (SELECT lang, phrase, max(f) AS most FROM inner_runs GROUP BY ALL),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM lowest c LEFT JOIN longer x USING (lang, phrase) WHERE x.most IS NULL OR 100 * x.most < 80 * c.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
