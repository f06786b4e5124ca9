"""The same answers in SQL over the given tables, written out step by step."""

from __future__ import annotations

from ..functions.sequences import DENSE, LETTERS

DEPTH, FMIN = 6, 4
LIMITS = (0.9, 0.97, 0.98, 0.99, 0.995, 1.0)
SAMPLES = "(SELECT count(DISTINCT source) FROM documents)"

NORMAL = "regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN0123.]', 'N', 'g')"
NODES = f"""
seqs AS (SELECT source AS sample, translate(text, '{LETTERS}', '{DENSE}') AS seq FROM documents),
pieces AS (SELECT sample, unnest(string_split_regex(seq, '[^ACGT]+')) AS run FROM seqs),
once AS (SELECT sample, run, count(*) AS w FROM pieces WHERE run <> '' GROUP BY sample, run),
runs AS (SELECT sample, run, w FROM once UNION ALL SELECT sample, translate(reverse(run), 'ACGT', 'TGCA'), w FROM once),
occ AS (SELECT sample, run, w, unnest(range(1, length(run) + 1)) AS p FROM runs),
win AS (SELECT sample, w, substr(run, p, {DEPTH}) AS win, CASE WHEN p > 1 THEN substr(run, p - 1, 1) END AS l FROM occ),
opened AS (SELECT sample, w, l, win, unnest(range(1, length(win) + 1)) AS k FROM win),
nodes AS (
  SELECT sample, substr(win, 1, k) AS path, CAST(sum(w) AS BIGINT) AS freq,
    CASE WHEN count(l) = 0 THEN '0' WHEN sum(CASE WHEN l IS NULL THEN 0 ELSE w END) = sum(w) AND min(l) = max(l) THEN min(l) ELSE 'N' END AS left_char
  FROM opened GROUP BY 1, 2 HAVING sum(w) >= {FMIN})"""
MERGED = f"""{NODES},
merged AS (
  SELECT path, count(*) AS n_samples, CAST(sum(freq) AS BIGINT) AS total_freq,
    log2({SAMPLES} + sum(freq)) - sum((freq + 1) * log2(freq + 1)) / ({SAMPLES} + sum(freq)) AS entropy,
    CASE WHEN min(left_char) = max(left_char) THEN min(left_char) ELSE 'N' END AS left_char
  FROM nodes GROUP BY path),
kids AS (SELECT substr(path, 1, length(path) - 1) AS parent, count(*) AS n_children, max(n_samples) AS child_samples FROM merged WHERE length(path) > 1 GROUP BY 1),
br AS (
  SELECT m.*, coalesce(n_children, 0) AS n_children, coalesce(child_samples, 0) AS child_samples,
    NOT (coalesce(n_children, 0) = 1 AND coalesce(child_samples, -1) = n_samples) AS right_branching,
    left_char NOT IN ('A', 'C', 'G', 'T') AS left_branching
  FROM merged m LEFT JOIN kids ON parent = path)"""
MINED = "SELECT path, n_samples, total_freq, round(entropy, 6) AS entropy FROM br WHERE right_branching AND left_branching"

COUNTS = """
raw AS (SELECT user_id AS row_id, event_type AS sample, count(*) AS freq FROM events GROUP BY 1, 2),
dims AS (SELECT DISTINCT event_type AS sample FROM events),
dense AS (SELECT r.row_id, d.sample, coalesce(raw.freq, 0) AS f, raw.freq IS NOT NULL AS present FROM (SELECT DISTINCT row_id FROM raw) r CROSS JOIN dims d LEFT JOIN raw ON raw.row_id = r.row_id AND raw.sample = d.sample),
ent AS (SELECT row_id, (log2(sum(f + 1)) - sum((f + 1) * log2(f + 1)) / sum(f + 1)) / log2(count(*)) AS entropy FROM dense GROUP BY row_id)"""
LIMIT_ROWS = ", ".join(f"({x})" for x in LIMITS)
BUCKETS = f"""{COUNTS},
limits(max_entropy) AS (VALUES {LIMIT_ROWS}),
bucketed AS (SELECT row_id, entropy, (SELECT min(CAST(max_entropy AS DOUBLE)) FROM limits WHERE entropy <= max_entropy) AS max_entropy FROM ent)"""
PAIRS = f"""{BUCKETS},
cells AS (
  SELECT CAST(l.max_entropy AS DOUBLE) AS max_entropy, a.sample AS s, b.sample AS t,
    sum(CASE WHEN a.present AND b.present THEN 1 ELSE 0 END) AS cnt,
    sum(CASE WHEN a.sample < b.sample THEN (ln(1 + a.f) - ln(1 + b.f)) ** 2 ELSE 0 END) AS log_d,
    sum(CASE WHEN a.sample < b.sample THEN (sqrt(a.f) - sqrt(b.f)) ** 2 ELSE 0 END) AS sqrt_d,
    sum(CASE WHEN a.sample < b.sample AND (a.present OR b.present) THEN lgamma(a.f + b.f + 1) - lgamma(a.f + 1) - lgamma(b.f + 1) - (a.f + b.f + 1) ELSE 0 END) AS lgamma_d
  FROM limits l JOIN bucketed k ON k.max_entropy <= l.max_entropy JOIN dense a ON a.row_id = k.row_id JOIN dense b ON b.row_id = k.row_id AND a.sample <= b.sample
  GROUP BY 1, 2, 3),
grid AS (SELECT CAST(max_entropy AS DOUBLE) AS max_entropy, a.sample AS s, b.sample AS t FROM limits, dims a, dims b WHERE a.sample <= b.sample),
full_ AS (SELECT g.max_entropy, g.s, g.t, coalesce(cnt, 0) AS cnt, coalesce(log_d, 0) AS log_d, coalesce(sqrt_d, 0) AS sqrt_d, coalesce(lgamma_d, 0) AS lgamma_d FROM grid g LEFT JOIN cells c ON c.max_entropy = g.max_entropy AND c.s = g.s AND c.t = g.t)"""

PATTERNS = "pats AS (SELECT word AS pattern, count(*) AS weight FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark) WHERE length(word) >= 3 GROUP BY word)"
OCCURRENCES = f"""{PATTERNS},
widths AS (SELECT DISTINCT length(pattern) AS n FROM pats),
spots AS (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS p FROM conversations),
grams AS (SELECT conv_id, turn, p, substr(text, p, n) AS gram FROM spots, widths WHERE p + n <= length(text) + 1),
occ AS (SELECT pattern, conv_id, turn, p - 1 AS pos FROM grams JOIN pats ON pattern = gram)"""
SUFFIXES = """
spots AS (SELECT conv_id, turn, text, unnest(range(1, length(text) + 2)) AS p FROM conversations),
suf AS (SELECT conv_id, turn, p - 1 AS pos, substr(text, p) AS suffix, CASE WHEN p > 1 THEN substr(text, p - 1, 1) ELSE '' END AS before FROM spots),
ranked AS (SELECT *, row_number() OVER (ORDER BY suffix, conv_id, turn, pos) - 1 AS sa_rank FROM suf)"""
BLOCK = 100
#: All suffixes start in the root; the members of a node of over BLOCK suffixes part by their next character, and those of a part
#: share as much as the least of their common prefixes says.
GRAPH = f"""{SUFFIXES},
above AS (SELECT sa_rank AS r, conv_id, turn, suffix AS s, lag(suffix) OVER (ORDER BY sa_rank) AS a FROM ranked),
cut AS (SELECT *, CASE WHEN substr(s, 1, 24) <> substr(a, 1, 24) THEN substr(s, 1, 24) ELSE s END AS c FROM above),
lcps AS (SELECT r, conv_id, turn, s, CAST(coalesce(len(list_filter(range(1, least(length(c), length(a)) + 1), lambda k: substr(c, 1, k) = substr(a, 1, k))), 0) AS BIGINT) AS lcp FROM cut),
tree AS (
  SELECT r, conv_id, turn, s, lcp, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS up, count(*) OVER () AS n FROM lcps
  UNION ALL
  SELECT r, conv_id, turn, s, lcp, f, min(CASE WHEN r <> f THEN lcp END) OVER (PARTITION BY f), depth, m FROM (
    SELECT t.*, min(r) OVER w AS f, count(*) OVER w AS m FROM tree t WHERE (n > {BLOCK} OR depth = 0) AND length(s) > depth
    WINDOW w AS (PARTITION BY first, depth, substr(s, depth + 1, 1))) WHERE m > 1)"""
ITEMS = """
items AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS pos FROM lineitem)"""
NAMED = "named AS (SELECT conv_id, turn, conv_id || '/' || turn AS name, regexp_replace(text, '[>@\r]', '', 'g') AS text FROM conversations)"
BITS = """
bits AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS bit FROM lineitem),
ranked AS (
  SELECT *, row_number() OVER o - 1 AS pos, CAST(sum(bit) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rank1
  FROM bits WINDOW o AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag))"""
LINES = "lines AS (SELECT conv_id, turn, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM conversations)"
WEIGHTS = "weights AS (SELECT doc_id AS pos, coalesce(n_chars, 0) AS weight FROM documents)"


def _matrix(column: str, value: str) -> str:
    return f"WITH {PAIRS} SELECT max_entropy, s, t, {value} AS {column} FROM full_"


ORACLE_SQL: dict[str, str] = {
    "normalize_sequences": f"SELECT doc_id, {NORMAL} AS seq FROM documents",
    "reverse_complement": f"SELECT doc_id, translate(reverse({NORMAL}), 'ACGT', 'TGCA') AS seq FROM documents",
    "strand_join": f"SELECT doc_id, {NORMAL} || '-' || translate(reverse({NORMAL}), 'ACGT', 'TGCA') AS seq FROM documents",
    "color_code": f"""WITH c AS (SELECT doc_id, string_split({NORMAL}, '') AS ch FROM documents)
        SELECT doc_id, CASE WHEN len(ch) < 2 THEN '' ELSE array_to_string(list_transform(list_zip(ch[1:len(ch) - 1], ch[2:]),
          lambda x: CASE WHEN x[1] IN ('A','C','G','T') AND x[2] IN ('A','C','G','T') THEN CAST(xor(strpos('ACGT', x[1]) - 1, strpos('ACGT', x[2]) - 1) AS VARCHAR) ELSE '.' END), '') END AS colors FROM c""",
    "trie_nodes": f"WITH {NODES} SELECT sample, path, freq FROM nodes",
    "left_char": f"WITH {NODES} SELECT sample, path, left_char FROM nodes",
    "nodes_prefix": f"WITH {NODES} SELECT sample, path, freq FROM nodes WHERE starts_with(path, 'AC') OR path = 'A'",
    "index_check": f"WITH s AS (SELECT {NORMAL} AS seq FROM documents), c AS (SELECT unnest(string_split(seq, '')) AS symbol FROM s) SELECT symbol, count(*) AS n, CAST((SELECT sum(length(seq)) FROM s) AS BIGINT) AS total FROM c WHERE symbol <> '' GROUP BY symbol",
    "merge_support": f"WITH {MERGED} SELECT path, n_samples, total_freq FROM merged",
    "merge_entropy": f"WITH {MERGED} SELECT path, round(entropy, 6) AS entropy FROM merged",
    "right_branching": f"WITH {MERGED} SELECT path, n_children, child_samples, right_branching FROM br",
    "left_branching": f"WITH {MERGED} SELECT path, left_char, left_branching FROM br",
    "mine_maximal": f"WITH {MERGED} {MINED} AND n_samples >= 2 AND entropy BETWEEN 1.0 AND 4.25",
    "mine_sample_specific": f"WITH {MERGED} {MINED} AND n_samples = 1",
    "mine_mindepth": f"WITH {MERGED} {MINED} AND n_samples >= 2 AND length(path) >= 5",
    "freq_histogram": f"WITH {MERGED} SELECT n_samples, count(*) AS n_paths FROM br WHERE right_branching AND left_branching AND n_samples >= 2 GROUP BY 1",
    "mine_summary": f"""WITH {MERGED} SELECT count(*) AS total_paths, CAST(count(*) FILTER (WHERE right_branching AND left_branching AND n_samples >= 2) AS BIGINT) AS outputs,
        CAST(sum(n_samples) FILTER (WHERE right_branching AND left_branching AND n_samples >= 2) AS BIGINT) AS occs, round(min(entropy) FILTER (WHERE n_samples > 1), 6) AS min_entropy, round(max(entropy) FILTER (WHERE n_samples > 1), 6) AS max_entropy FROM br""",
    "mine_observed": f"""WITH {MERGED} SELECT count(*) AS total_paths, CAST(count(*) FILTER (WHERE right_branching AND left_branching AND n_samples >= 2) AS BIGINT) AS outputs,
        CAST(sum(n_samples) FILTER (WHERE right_branching AND left_branching AND n_samples >= 2) AS BIGINT) AS occs, round(min(entropy) FILTER (WHERE n_samples > 1), 6) AS min_entropy, round(max(entropy) FILTER (WHERE n_samples > 1), 6) AS max_entropy,
        CAST(count(*) FILTER (WHERE right_branching AND left_branching AND n_samples >= 2 AND n_samples % 2 = 0) AS BIGINT) AS even_outputs FROM br""",
    "row_format": f"""WITH {MERGED}, o AS (SELECT path, entropy FROM br WHERE right_branching AND left_branching AND n_samples >= 2), l AS (SELECT path, string_agg(sample || ':' || freq, ' ' ORDER BY sample) AS pairs FROM nodes GROUP BY path)
        SELECT path, path || ' ' || format('{{:.4f}}', round(entropy, 4)) || ' ' || pairs AS line FROM o JOIN l USING (path)""",
    "row_parse": f"WITH {MERGED}, o AS ({MINED} AND n_samples >= 2) SELECT n.path, n.sample, n.freq FROM nodes n JOIN o ON o.path = n.path",
    "run_to_sample": """WITH runs AS (SELECT user_id AS row_id, event_type AS sample, event_id % 2 AS half, count(*) AS freq FROM events GROUP BY 1, 2, 3)
        SELECT row_id, sample, arg_max(freq, half) AS freq FROM runs GROUP BY 1, 2""",
    "norm_entropy": f"WITH {COUNTS} SELECT row_id, round(entropy, 6) AS entropy FROM ent",
    "size_norm_entropy": f"""WITH {COUNTS}, sizes AS (SELECT event_type AS sample, avg(value) AS size FROM events GROUP BY 1), f AS (SELECT row_id, f / size AS f FROM dense JOIN sizes USING (sample))
        SELECT row_id, round((log2(sum(f + 1)) - sum((f + 1) * log2(f + 1)) / sum(f + 1)) / log2(count(*)), 6) AS entropy FROM f GROUP BY row_id""",
    "entropy_bucket": f"WITH {BUCKETS} SELECT row_id, max_entropy FROM bucketed",
    "count_matrix": _matrix("cnt", "CAST(cnt AS BIGINT)"),
    "log_matrix": _matrix("log_d", "round(log_d, 6)"),
    "sqrt_matrix": _matrix("sqrt_d", "round(sqrt_d, 6)"),
    "lgamma_matrix": _matrix("lgamma_d", "round(lgamma_d, 4)"),
    "threshold_rows": f"WITH {BUCKETS} SELECT CAST(l.max_entropy AS DOUBLE) AS max_entropy, count(row_id) AS n_rows FROM limits l LEFT JOIN bucketed k ON k.max_entropy <= l.max_entropy GROUP BY 1",
    "pattern_count": f"WITH {OCCURRENCES} SELECT pattern, count(*) AS n, count(DISTINCT (conv_id, turn)) AS n_texts FROM occ GROUP BY pattern",
    "pattern_locate": f"WITH {OCCURRENCES} SELECT pattern, conv_id, turn, pos FROM occ",
    "locate_multi": f"WITH {OCCURRENCES} SELECT DISTINCT conv_id, turn, pos FROM occ",
    "list_documents": f"WITH {OCCURRENCES} SELECT DISTINCT pattern, conv_id FROM occ",
    "kwic": f"WITH {OCCURRENCES} SELECT pattern, conv_id, turn, pos, substr(text, greatest(pos - 10, 0) + 1, pos - greatest(pos - 10, 0) + length(pattern) + 10) AS shown FROM occ JOIN conversations USING (conv_id, turn)",
    "display_range": "SELECT doc_id, CASE WHEN length(text) >= 50 THEN substr(text, 11, 40) END AS shown, substr(text, 1, 40) AS head FROM documents",
    "seq_ranges": "SELECT doc_id, CAST(sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS BIGINT) AS first, CAST(sum(length(text)) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS last FROM documents",
    "grep_lines": f"WITH {LINES} SELECT DISTINCT line FROM lines WHERE contains(line, 'tion')",
    "grep_count": f"WITH {LINES} SELECT conv_id, count(*) AS n_lines FROM lines WHERE contains(line, 'tion') GROUP BY conv_id",
    "bwt": f"WITH {SUFFIXES} SELECT sa_rank, before AS symbol FROM ranked",
    "bwt_runs": f"WITH {SUFFIXES}, l AS (SELECT before, lag(before) OVER (ORDER BY sa_rank) AS last FROM ranked) SELECT before AS symbol, count(*) AS n_runs FROM l WHERE before <> '' AND (last IS NULL OR last <> before) GROUP BY 1",
    "suffix_rank": f"WITH {SUFFIXES} SELECT conv_id, turn, pos, sa_rank FROM ranked",
    "merged_suffix_rank": f"WITH {SUFFIXES} SELECT conv_id, turn, pos, sa_rank, before AS symbol FROM ranked",
    "lcp_array": f"""WITH {SUFFIXES}, l AS (SELECT sa_rank, suffix, lag(suffix) OVER (ORDER BY sa_rank) AS above FROM ranked),
        cut AS (SELECT sa_rank, CASE WHEN substr(suffix, 1, 24) <> substr(above, 1, 24) THEN substr(suffix, 1, 24) ELSE suffix END AS suffix, above FROM l)
        SELECT sa_rank, coalesce(len(list_filter(range(1, least(length(suffix), length(above)) + 1), lambda k: substr(suffix, 1, k) = substr(above, 1, k))), 0) AS lcp FROM cut""",
    "weighted_found": f"WITH {OCCURRENCES} SELECT conv_id, turn, pos, CAST(sum(weight) AS BIGINT) AS weight FROM occ JOIN pats USING (pattern) GROUP BY 1, 2, 3",
    "greedy_samples": f"""WITH {WEIGHTS}, n AS (SELECT count(*) AS n FROM weights), reg AS (SELECT pos, weight FROM weights WHERE pos % 16 = 0),
        heavy AS (SELECT pos, weight, row_number() OVER (ORDER BY weight DESC, pos DESC) AS r FROM weights WHERE pos % 16 <> 0 AND weight > 0)
        SELECT pos, weight, TRUE AS regular FROM reg UNION ALL SELECT pos, weight, FALSE FROM heavy WHERE r <= greatest(0, (SELECT (n + 7) // 8 FROM n) - (SELECT count(*) FROM reg))""",
    "optimal_samples": f"""WITH RECURSIVE {WEIGHTS}, size AS (SELECT max(pos) + 1 AS n FROM weights),
        places AS (SELECT pos, sum(weight) AS weight FROM (SELECT pos, weight FROM weights WHERE weight > 0 UNION ALL SELECT 0, 0 UNION ALL SELECT n, 0 FROM size) GROUP BY 1),
        pre AS (SELECT pos, CAST(sum(weight) OVER w - weight AS BIGINT) AS w, CAST(sum(weight * pos) OVER w - weight * pos AS BIGINT) AS d FROM places WINDOW w AS (ORDER BY pos)),
        links AS (SELECT least((n + 7) // 8, (SELECT count(*) - 1 FROM places)) AS k FROM size),
        best AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS cost UNION ALL
            SELECT b.k + 1, j.pos, min(b.cost + j.d - i.d - i.pos * (j.w - i.w)) FROM best b JOIN pre i ON i.pos = b.pos JOIN pre j ON j.pos > i.pos
            WHERE b.k < (SELECT k FROM links) GROUP BY b.k + 1, j.pos)
        SELECT k AS n_samples, cost FROM best WHERE k = (SELECT k FROM links) AND pos = (SELECT n FROM size)""",
    "bit_rank": f"WITH {BITS} SELECT pos, rank1, pos + 1 - rank1 AS rank0 FROM ranked",
    "bit_select": f"WITH {BITS} SELECT rank1 AS k, pos FROM ranked WHERE bit = 1",
    "select_next": f"WITH {BITS} SELECT pos, coalesce(min(CASE WHEN bit = 1 THEN pos END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS next_one FROM ranked",
    "symbol_rank": f"WITH {ITEMS} SELECT pos, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY pos) AS sym_rank FROM items",
    "symbol_counts": "WITH c AS (SELECT l_linenumber AS symbol, count(*) AS n FROM lineitem GROUP BY 1) SELECT symbol, n, CAST(sum(n) OVER (ORDER BY symbol) - n AS BIGINT) AS below FROM c",
    "symbol_runs": "WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem), u AS (SELECT l_suppkey, l_orderkey * 100 + l_linenumber AS spot, min(l_returnflag) AS flag FROM d GROUP BY 1, 2), l AS (SELECT l_suppkey, flag, lag(flag) OVER (PARTITION BY l_suppkey ORDER BY spot) AS last FROM u) SELECT l_suppkey, CAST(sum(CASE WHEN last IS NULL OR last <> flag THEN 1 ELSE 0 END) AS BIGINT) AS n_runs FROM l GROUP BY 1",
    "range_report": f"WITH {ITEMS}, n AS (SELECT count(*) AS n FROM items) SELECT pos, l_linenumber FROM items, n WHERE pos BETWEEN n // 4 AND 3 * n // 4 AND l_linenumber BETWEEN 2 AND 4",
    "range_count": f"WITH {ITEMS}, n AS (SELECT count(*) AS n FROM items) SELECT l_suppkey, count(*) AS n FROM items, n WHERE pos BETWEEN n.n // 4 AND 3 * n.n // 4 AND l_linenumber BETWEEN 2 AND 4 GROUP BY 1",
    "edit_distance": "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part",
    "hamming": "SELECT p_partkey, CAST(hamming(p_name, reverse(p_name)) AS INTEGER) AS n FROM part",
    "page_tags": "SELECT page_id, len(t) AS n, t[1] AS first FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS t FROM pages)",
    "text_chunks": "SELECT doc_id, k AS chunk, substr(text, k * 1000 + 1, 1000) AS part FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS k FROM documents)",
    "fasta_records": f"WITH {NAMED} SELECT name, replace(text, chr(10), '') AS seq FROM named",
    "norm_matrices": f"""WITH {BUCKETS}, sizes AS (SELECT event_type AS sample, avg(value) AS size FROM events GROUP BY 1), n AS (SELECT row_id, sample, f / size AS f FROM dense JOIN sizes USING (sample)),
        cells AS (SELECT CAST(l.max_entropy AS DOUBLE) AS max_entropy, a.sample AS s, b.sample AS t, sum(CASE WHEN a.sample < b.sample THEN (ln(1 + a.f) - ln(1 + b.f)) ** 2 ELSE 0 END) AS log_d, sum(CASE WHEN a.sample < b.sample THEN (sqrt(a.f) - sqrt(b.f)) ** 2 ELSE 0 END) AS sqrt_d
          FROM limits l JOIN bucketed k ON k.max_entropy <= l.max_entropy JOIN n a ON a.row_id = k.row_id JOIN n b ON b.row_id = k.row_id AND a.sample <= b.sample GROUP BY 1, 2, 3),
        grid AS (SELECT CAST(max_entropy AS DOUBLE) AS max_entropy, a.sample AS s, b.sample AS t FROM limits, dims a, dims b WHERE a.sample <= b.sample)
        SELECT g.max_entropy, g.s, g.t, round(coalesce(log_d, 0), 6) AS log_d, round(coalesce(sqrt_d, 0), 6) AS sqrt_d FROM grid g LEFT JOIN cells c ON c.max_entropy = g.max_entropy AND c.s = g.s AND c.t = g.t""",
    "incremental_nodes": f"WITH {NODES} SELECT sample, path, freq, left_char FROM nodes",
    "value_before": f"WITH {BITS} SELECT pos, coalesce(max(CASE WHEN bit = 1 THEN pos END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS last_one FROM ranked",
    "largest_up_to": f"""WITH {ITEMS}, m AS (SELECT pos, l_linenumber, max(CASE WHEN l_linenumber <= 4 THEN l_linenumber END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS largest,
        {', '.join(f'sum(CAST(l_linenumber = {k} AS INT)) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n{k}' for k in range(1, 5))} FROM items)
        SELECT pos, coalesce(largest, -1) AS largest, CAST(CASE largest WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 WHEN 4 THEN n4 ELSE 0 END AS BIGINT) AS rank FROM m""",
    "inverse_suffix_array": f"WITH {SUFFIXES} SELECT row_number() OVER (ORDER BY conv_id, turn, pos) - 1 AS sa_rank, sa_rank AS value FROM ranked",
    "sized_parts": "SELECT doc_id, CAST(floor((sum(length(text)) OVER (ORDER BY doc_id) - length(text)) / 100000) AS BIGINT) AS part FROM documents",
    "top_paths": f"WITH {MERGED} SELECT path, total_freq FROM br WHERE right_branching AND left_branching AND n_samples >= 2 ORDER BY total_freq DESC, path LIMIT 100",
    "integer_logs": "SELECT doc_id, CAST(length(bin(n_chars)) AS INTEGER) AS bits, CAST(CASE WHEN n_chars < 1 THEN 0 ELSE length(bin(n_chars)) - 1 END AS INTEGER) AS low, CAST(CASE WHEN n_chars <= 1 THEN 0 ELSE length(bin(n_chars - 1)) END AS INTEGER) AS high, (n_chars // 16 + 1) * 16 AS multiple FROM documents",
    "pattern_trim": f"WITH p AS (SELECT item_id, CASE WHEN length(text) <= 40 THEN '' ELSE substr({NORMAL}, 21, length({NORMAL}) - 40) END AS pattern FROM benchmark) SELECT item_id, pattern, translate(reverse(pattern), 'ACGT', 'TGCA') AS reversed FROM p",
    "tab_rows": f"WITH {OCCURRENCES} SELECT pattern, conv_id || '/' || turn AS ref, pos, concat_ws(chr(9), pattern, conv_id || '/' || turn, pos + 1, pos + length(pattern), 'F') AS line FROM occ",
    "sam_rows": f"WITH {OCCURRENCES} SELECT pattern, conv_id || '/' || turn AS ref, pos, concat_ws(chr(9), pattern, '0', conv_id || '/' || turn, pos + 1, '255', length(pattern) || 'M', '*', '0', '0', pattern, '*') AS line FROM occ",
    "symbol_select": f"WITH {ITEMS} SELECT l_linenumber, row_number() OVER (PARTITION BY l_linenumber ORDER BY pos) AS k, pos FROM items",
    "sequence_suffixes": f"WITH {SUFFIXES} SELECT conv_id, turn, pos, row_number() OVER (PARTITION BY conv_id, turn ORDER BY suffix) - 1 AS own_rank FROM suf",
    "weighted_positions": """WITH w AS (SELECT doc_id, coalesce(n_chars, 0) AS weight FROM documents), c AS (SELECT doc_id, weight, sum(weight) OVER (ORDER BY doc_id) AS upto FROM w), k AS (SELECT unnest(range(0, 100)) AS draw)
        SELECT draw, doc_id FROM k JOIN c ON (2 * draw + 1) * (SELECT sum(weight) FROM w) > 200 * (upto - weight) AND (2 * draw + 1) * (SELECT sum(weight) FROM w) <= 200 * upto""",
    "passage_locate": """WITH hit AS (SELECT item_id, doc_id, b.text AS pattern, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        spots AS (SELECT item_id, doc_id, pattern, text, unnest(range(1, length(text) - length(pattern) + 2)) AS p FROM hit)
        SELECT item_id, doc_id, p - 1 AS pos FROM spots WHERE substr(text, p, length(pattern)) = pattern""",
    "display_sequence": "SELECT conv_id, turn, text || '$' AS shown FROM conversations",
    "position_lookup": """WITH r AS (SELECT doc_id, CAST(sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS BIGINT) AS first, CAST(sum(length(text)) OVER (ORDER BY doc_id) AS BIGINT) AS after FROM documents),
        asked AS (SELECT event_id, (event_id * 1000003) % (SELECT max(after) FROM r) AS pos FROM events)
        SELECT event_id, pos, doc_id, pos - first AS offset FROM asked JOIN r ON first <= pos AND pos < after""",
    "character_at": """WITH c AS (SELECT c AS symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE c <> '' GROUP BY 1),
        b AS (SELECT symbol, sum(n) OVER (ORDER BY symbol) - n AS below, sum(n) OVER (ORDER BY symbol) AS upto FROM c),
        asked AS (SELECT event_id, CAST((event_id * 1000003) % (SELECT sum(n) FROM c) AS BIGINT) AS rank FROM events)
        SELECT event_id, rank, symbol FROM asked JOIN b ON below <= rank AND rank < upto""",
    "ones_around": f"""WITH {BITS}, near AS (SELECT pos, coalesce(max(CASE WHEN bit = 1 THEN pos END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS one_before,
          coalesce(min(CASE WHEN bit = 1 THEN pos END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS one_after FROM ranked),
        asked AS (SELECT event_id, (event_id * 1000003) % (SELECT count(*) FROM ranked) AS pos FROM events)
        SELECT event_id, pos, one_before, one_after FROM asked JOIN near USING (pos)""",
    "rectangle_counts": f"""WITH {ITEMS}, n AS (SELECT count(*) AS n FROM items),
        sides AS (SELECT s_suppkey, (s_suppkey * 7919) % n AS low, (s_suppkey * 7919) % n + n // 3 AS high, (s_suppkey * 31) % 150 AS least, (s_suppkey * 31) % 150 + 200 + s_suppkey AS most FROM supplier, n)
        SELECT s_suppkey, count(pos) AS n FROM sides LEFT JOIN items ON pos BETWEEN low AND high AND l_partkey BETWEEN least AND most GROUP BY 1""",
    "display_from_rank": f"WITH {SUFFIXES} SELECT sa_rank, substr(suffix, 1, 40) AS shown FROM ranked",
    "pattern_draw": f"""WITH {PATTERNS}, c AS (SELECT pattern, weight, sum(weight) OVER (ORDER BY pattern) AS upto FROM pats), k AS (SELECT unnest(range(0, 100)) AS draw)
        SELECT draw, pattern FROM k JOIN c ON (2 * draw + 1) * (SELECT sum(weight) FROM pats) > 200 * (upto - weight) AND (2 * draw + 1) * (SELECT sum(weight) FROM pats) <= 200 * upto""",
    "random_patterns": f"""WITH {PATTERNS}, c AS (SELECT pattern, sum(weight) OVER (ORDER BY pattern) - weight AS first, sum(weight) OVER (ORDER BY pattern) AS after FROM pats),
        x0 AS (SELECT draw, ((draw + 1) * 2654435761 + 3735928559) % 4294967296 AS x FROM (SELECT unnest(range(0, 1000)) AS draw)),
        x1 AS (SELECT draw, (xor(x, x >> 16) * 73244475) % 4294967296 AS x FROM x0), x2 AS (SELECT draw, (xor(x, x >> 16) * 73244475) % 4294967296 AS x FROM x1),
        spots AS (SELECT draw, (xor(x, x >> 16) * CAST((SELECT sum(weight) FROM pats) AS BIGINT)) >> 32 AS spot FROM x2)
        SELECT draw, pattern FROM spots JOIN c ON first <= spot AND spot < after""",
    "zero_select": f"WITH {BITS} SELECT pos + 1 - rank1 AS k, pos FROM ranked WHERE bit = 0",
    "zero_next": f"WITH {BITS} SELECT pos, coalesce(min(CASE WHEN bit = 0 THEN pos END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS next_zero FROM ranked",
    "symbol_next": f"WITH {ITEMS} SELECT pos, coalesce(lead(pos) OVER (PARTITION BY l_returnflag ORDER BY pos), -1) AS next FROM items",
    "rank_below": f"""WITH {ITEMS}, seen AS (SELECT pos, l_linenumber, {', '.join(f'sum(CAST(l_linenumber = {k} AS INT)) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n{k}' for k in range(1, 8))} FROM items)
        SELECT pos, CAST({' + '.join(f'CASE WHEN l_linenumber > {k} THEN n{k} ELSE 0 END' for k in range(1, 8))} AS BIGINT) AS below FROM seen""",
    "run_lengths": f"""WITH {ITEMS}, h AS (SELECT pos, l_returnflag, CASE WHEN lag(l_returnflag) OVER (ORDER BY pos) = l_returnflag THEN 0 ELSE 1 END AS new FROM items),
        r AS (SELECT pos, l_returnflag, CAST(sum(new) OVER (ORDER BY pos) AS BIGINT) AS run FROM h)
        SELECT run, l_returnflag, min(pos) AS first, count(*) AS length FROM r GROUP BY run, l_returnflag""",
    "character_counts": "WITH c AS (SELECT c AS symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE c <> '' GROUP BY 1) SELECT symbol, n, CAST(sum(n) OVER (ORDER BY symbol) - n AS BIGINT) AS below FROM c",
    "mismatch_rows": """WITH c AS (SELECT p_partkey, string_split(p_name, '') AS a, string_split(reverse(p_name), '') AS b FROM part)
        SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i]), lambda i: (i - 1) || ' ' || b[i]), ' ') AS listed FROM c""",
    "deep_nodes": "WITH " + NODES.replace(f"translate(text, '{LETTERS}', '{DENSE}')", NORMAL).replace(f"substr(run, p, {DEPTH})", "substr(run, p)").replace(f"HAVING sum(w) >= {FMIN}", "HAVING sum(w) >= 3") + " SELECT sample, path, freq, left_char FROM nodes",
    "post_order": f"WITH {MERGED}, o AS ({MINED} AND n_samples >= 2) SELECT path, row_number() OVER (ORDER BY path || '~') - 1 AS nth FROM o",
    "fasta_qualities": f"WITH {NAMED} SELECT name, replace(text, chr(10), '') AS seq, replace(reverse(text), chr(10), '') AS qual FROM named",
    "fasta_source": f"WITH {NAMED} SELECT name, replace(text, chr(10), '') AS seq FROM named",
    "fastq_source": f"WITH {NAMED}, f AS (SELECT name, replace(text, chr(10), ' ') AS t FROM named) SELECT name, t AS seq, reverse(t) AS qual FROM f",
    "fixed_width_file": "WITH p AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS pattern FROM orders) SELECT row_number() OVER (ORDER BY pattern) - 1 AS nth, pattern FROM p",
    "fastq_records": f"WITH {NAMED}, f AS (SELECT name, replace(text, chr(10), ' ') AS t FROM named) SELECT name, t AS seq, '@' || reverse(t) AS qual FROM f",
    "reads_window": f"WITH {NAMED}, f AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS nth, replace(text, chr(10), ' ') AS seq FROM named) SELECT nth, seq, reverse(seq) AS qual FROM f WHERE nth BETWEEN 20 AND 69",
    "lower_lines": f"WITH {LINES} SELECT lower(line) AS seq FROM lines WHERE line <> ''",
    "run_map_lines": "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS run, CAST(s_nationkey AS BIGINT) AS sample FROM supplier",
    "pattern_file": f"WITH {PATTERNS} SELECT pattern, weight FROM pats",
    "strain_chunks": f"""WITH {ITEMS}, b AS (SELECT 0 AS strain, pos, l_returnflag AS c FROM items UNION ALL SELECT 1, pos, l_linestatus FROM items UNION ALL SELECT 2, pos, l_returnflag FROM items WHERE l_linenumber % 3 <> 0),
        n AS (SELECT strain, c, row_number() OVER (PARTITION BY strain ORDER BY pos) - 1 AS k FROM b) SELECT strain, k // 1000 AS chunk, string_agg(c, '' ORDER BY k) AS text FROM n GROUP BY 1, 2""",
    "library_names": "SELECT page_id, split_part(list_extract(string_split(url, '/'), -1), '.', 1) AS name FROM pages",
    "events_by_time": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS nth FROM events",
    "minfreq_rows": f"WITH {COUNTS} SELECT row_id, sample, freq FROM raw WHERE freq >= 3",
    "step_thresholds": f"WITH {COUNTS}, l AS (SELECT unnest(list_append(list_transform(range(0, 14), lambda i: i * CAST(0.07 AS DOUBLE)), CAST(1.0 AS DOUBLE))) AS x) SELECT round(x, 6) AS max_entropy, count(row_id) AS n_rows FROM l LEFT JOIN ent ON entropy <= x GROUP BY 1",
    "matrix_file": f"""WITH {PAIRS}, square AS (SELECT max_entropy, s, t, cnt FROM full_ UNION ALL SELECT max_entropy, t, s, 0 FROM full_ WHERE s <> t),
        line AS (SELECT max_entropy, s, ' ' || string_agg(CAST(CAST(cnt AS BIGINT) AS VARCHAR), ' ' ORDER BY t) AS line FROM square GROUP BY 1, 2)
        SELECT CAST(l.max_entropy AS DOUBLE) AS max_entropy, 0 AS line_no, printf('Matrix for <max_entropy>=<%f> was computed from %d substrings: ', CAST(l.max_entropy AS DOUBLE), count(row_id)) AS line FROM limits l LEFT JOIN bucketed k ON k.max_entropy <= l.max_entropy GROUP BY l.max_entropy
        UNION ALL SELECT max_entropy, row_number() OVER (PARTITION BY max_entropy ORDER BY s), line FROM line""",
    "document_nodes": f"WITH RECURSIVE {GRAPH} SELECT substr(min(s), 1, depth) AS path, substr(min(s), 1, up) AS parent, count(*) AS n_suffixes, count(DISTINCT (conv_id, turn)) AS n_docs FROM tree WHERE depth > 0 GROUP BY first, depth, up",
    "document_edges": f"WITH RECURSIVE {GRAPH} SELECT DISTINCT substr(s, 1, depth) AS path, conv_id, turn FROM tree WHERE depth > 0",
    "null_separated": "SELECT text AS seq FROM conversations WHERE text <> ''",
    "sample_names": "SELECT s_name AS name FROM supplier",
    "size_lines": "SELECT s_name AS name, s_acctbal AS size FROM supplier",
}
