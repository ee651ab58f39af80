"""SQL fragments (DuckDB dialect) that the reference statements of the queries share."""

from __future__ import annotations

from grainscope.operators.residuals import DIVISORS, kernel_taps
from grainscope.schemas import VARIANTS

# 64 x 64 rasters of the embeddings
PX = """px AS (
  SELECT vec_id // 64 AS photo_id, (vec_id % 64) * 64 + pos - 1 AS i, vec_id % 64 AS y, pos - 1 AS x,
         CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS INTEGER) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""

# 8 x 8 rasters, one per vector
TILE_PX = """px AS (
  SELECT 'label' || label AS source, vec_id AS photo_id, pos - 1 AS i, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x,
         CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS INTEGER) AS v
  FROM (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""

# bytes of whole documents, 32 per row
DOC_PX = """px AS (
  SELECT source, doc_id AS photo_id, pos - 1 AS i, (pos - 1) // 32 AS y, (pos - 1) % 32 AS x,
         CAST('0x' || b AS INTEGER) AS v
  FROM (SELECT source, doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS pos
        FROM (SELECT source, doc_id, regexp_extract_all(hex(encode(text)), '..') AS bs FROM documents)))"""


def chi_p(stat: str, df: str) -> str:
    """Chi-square survival by the series of the lower incomplete gamma function."""
    h, a = f"(({stat}) / 2.0)", f"(({df}) / 2.0)"
    return (f"(CASE WHEN {h} <= 0 THEN 1.0 WHEN {h} > 700 THEN 0.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform("
            f"range(CAST(2 * {h} + 200 AS BIGINT)), lambda t: exp(-{h} + ({a} + t) * ln({h}) - lgamma({a} + t + 1))))) END)")


def stages(key: str = "photo_id", extra: str = "") -> str:
    """CTEs from px: n, prefix (cumulative pairs), chi per prefix with p, rs, diff."""
    return f"""
nn AS (SELECT {key}, count(*) AS n FROM px GROUP BY ALL),
hk AS (SELECT {key}, CASE WHEN i < 64 THEN 1 ELSE (20 * (i + 1) + n - 1) // n END AS k0, v, count(*) AS c
       FROM px JOIN nn USING ({key}) GROUP BY ALL),
pk AS (SELECT {key}, k, v // 2 AS pair, sum(CASE WHEN v % 2 = 0 THEN c ELSE 0 END) AS e,
              sum(CASE WHEN v % 2 = 1 THEN c ELSE 0 END) AS o
       FROM hk JOIN (SELECT unnest(range(1, 21)) AS k) ON k0 <= k GROUP BY ALL),
ck AS (SELECT {key}, k, sum((e - o) * (e - o) / CAST(e + o AS DOUBLE)) AS stat, count(*) AS np,
              sum(e) AS zeros, sum(o) AS ones FROM pk GROUP BY ALL),
ckp AS (SELECT *, CASE WHEN np > 1 THEN {chi_p('stat', 'np - 1')} END AS tail FROM ck),
med AS (SELECT {key}, quantile_cont(coalesce(tail, 1.0), 0.5) AS median_prefix_p,
               max(CASE WHEN k = 20 THEN stat END) AS chi2_stat, max(CASE WHEN k = 20 THEN np END) AS n_pairs,
               max(CASE WHEN k = 20 THEN coalesce(tail, 1.0) END) AS chi2_pvalue
        FROM ckp GROUP BY ALL),
quad AS (SELECT {key}, i // 4 AS g, max(CASE WHEN i % 4 = 0 THEN v END) AS a, max(CASE WHEN i % 4 = 1 THEN v END) AS b,
                max(CASE WHEN i % 4 = 2 THEN v END) AS c, max(CASE WHEN i % 4 = 3 THEN v END) AS d
         FROM px GROUP BY ALL HAVING count(*) = 4),
rough AS (SELECT {key}, abs(b - a) + abs(c - b) + abs(d - c) AS f,
                 abs(xor(b, 1) - a) + abs(xor(c, 1) - xor(b, 1)) + abs(d - xor(c, 1)) AS fm,
                 abs(b - xor(a, 1)) + abs(c - b) + abs(xor(d, 1) - c) AS fn FROM quad),
rs AS (SELECT {key}, count_if(fm > f) AS rm, count_if(fm < f) AS sm, count_if(fn > f) AS rn,
              count_if(fn < f) AS sn, count(*) AS ng FROM rough GROUP BY ALL),
rsg AS (SELECT nn.{', nn.'.join(key.split(', '))}, coalesce(rm, 0) AS "Rm", coalesce(sm, 0) AS "Sm", coalesce(rn, 0) AS "Rn",
               coalesce(sn, 0) AS "Sn", coalesce((rm - sm) / CAST(ng AS DOUBLE), 0.0) AS gr,
               coalesce((rn - sn) / CAST(ng AS DOUBLE), 0.0) AS gn FROM nn LEFT JOIN rs USING ({key})),
nb AS (SELECT {key}, abs(v - lead(v) OVER (PARTITION BY {key}, y ORDER BY x)) AS d FROM px
       UNION ALL SELECT {key}, abs(v - lead(v) OVER (PARTITION BY {key}, x ORDER BY y)) FROM px),
dh AS (SELECT {key}, d, count(*) AS c FROM nb WHERE d IS NOT NULL GROUP BY ALL),
dl AS (SELECT {key}, d % 2 AS d, sum(c) AS c FROM dh GROUP BY ALL),
en AS (SELECT {key}, -sum(q * log2(q)) AS h FROM (SELECT {key}, c / CAST(sum(c) OVER (PARTITION BY {key}) AS DOUBLE) AS q
       FROM dh) GROUP BY ALL),
el AS (SELECT {key}, -sum(q * log2(q)) AS lg FROM (SELECT {key}, c / CAST(sum(c) OVER (PARTITION BY {key}) AS DOUBLE) AS q
       FROM dl) GROUP BY ALL),
ent AS (SELECT nn.{', nn.'.join(key.split(', '))}, coalesce(h, 0.0) AS h, coalesce(lg, 0.0) AS lg
        FROM nn LEFT JOIN en USING ({key}) LEFT JOIN el USING ({key})){extra}"""


def detector(key: str = "photo_id", name: str = "det") -> str:
    """CTEs after stages(): detector signals per image."""
    return f""",
t0 AS (SELECT {key}, h, lg, gr, gn, median_prefix_p AS mp, chi2_pvalue, chi2_stat,
              least(1.0, greatest(0.0, (h - 1.2) / 5.8)) AS tex, least(1.0, greatest(0.0, (lg - 0.90) / 0.08)) AS lr
       FROM med JOIN rsg USING ({key}) JOIN ent USING ({key})),
t1 AS (SELECT *, 0.62 * (1.0 - 0.8 * tex) + 0.06 * tex AS base FROM t0),
t2 AS (SELECT *, 1.0 / (1.0 + exp(-((greatest(0.0, (base - gn) / greatest(base, 1e-3)) - (0.34 + 0.20 * tex)) / 0.12))) AS s_rs,
              least(1.0, greatest(0.0, (mp - 0.35) / 0.5)) * (1 - tex) * (1 - tex) AS s_chi,
              least(1.0, greatest(0.0, 0.55 * greatest(0.0, (0.62 - gn) / 0.62) + 0.45 * greatest(0.0, (0.72 - gr) / 0.72))) AS rate_rs
       FROM t1),
t3 AS (SELECT *, greatest(s_rs, s_chi) AS raw FROM t2),
{name} AS (SELECT *, CASE WHEN tex >= 0.55 THEN 'noisy content' WHEN lr > 0 THEN 'random low bits' END AS abstain,
         CASE WHEN tex >= 0.55 THEN least(0.62, greatest(0.5, 0.5 + 0.10 * raw))
              WHEN lr > 0 THEN least(0.62, greatest(0.5, 0.5 + 0.12 * lr * raw))
              WHEN tex < 0.35 AND gn / 0.62 > 0.82 AND mp < 0.1 THEN least(0.15, least(1.0, greatest(0.0, 0.04 + 0.96 * raw)))
              ELSE least(1.0, greatest(0.0, 0.04 + 0.96 * raw)) END AS prob FROM t3)"""


SENSITIVITY = "(VALUES ('strict', 0.50, 0.80, 0.85), ('balanced', 0.40, 0.70, 1.00), ('loose', 0.30, 0.60, 1.18)) AS s(sensitivity, possible, high, pull)"


def kernels(which: range) -> str:
    rows = ", ".join(f"({c}, {dy}, {dx}, {w}, {DIVISORS[c]})"
                     for c in which for (dy, dx), w in kernel_taps()[c].items())
    return f"kern AS (SELECT * FROM (VALUES {rows}) AS t(c, dy, dx, w, dv))"


def variant_rows(count: int = 12) -> str:
    rows = ", ".join(f"('{v}', '{m}', {p}, CAST({d} AS DOUBLE))" for v, m, p, d in VARIANTS[:count])
    return f"var AS (SELECT * FROM (VALUES {rows}) AS t(variant, method, p, density))"


def _xor_of_masks() -> str:
    sums = []
    for mask in range(1, 128):
        x = 0
        for j in range(1, 8):
            if mask >> (j - 1) & 1:
                x ^= j
        sums.append(str(x))
    return "[" + ", ".join(sums) + "]"


#: Cells that a wet-paper block changes when neither its target nor a pair will do: the sums that dry columns reach, with the
#: number of columns of the first way to each.
_REACHED = """list_reduce([list_transform(range(1 << p), lambda s: CASE WHEN s = 0 THEN 0 ELSE -1 END)] || list_transform(dry, lambda c: [c]),
            lambda a, x: list_transform(range(len(a)), lambda s: CASE WHEN a[s + 1] >= 0 THEN a[s + 1]
              WHEN a[xor(s, x[1]) + 1] >= 0 THEN a[xor(s, x[1]) + 1] + 1 ELSE -1 END))[d + 1]"""


def blocks_changed(count: int = 12) -> str:
    """CTEs from px and var: bp(photo_id, variant, in_head, blk, d, pick), where ``pick`` is the number of changed cells of a block,
    -1 for the flip of the target. For code parameters of any size."""
    body = coded(count)
    body = body[:body.index("bp AS (")].replace(
        ",\n       coalesce(bit_or(CASE WHEN abs(v - 128) > 1 THEN 1 << (j - 1) END), 0) AS dm", "").replace(
        "coalesce(bit_or(CASE WHEN abs(v - 128) > 1 THEN 1 << (j - 1) END), 0) AS dm", "0 AS dm")
    return body + f"""bp AS (SELECT photo_id, variant, in_head, blk, d, CASE WHEN d = 0 THEN 0 WHEN method = 'matrix' THEN -1
          WHEN list_contains(dry, d) THEN 1
          WHEN len(list_filter(dry, lambda a: a < xor(a, d) AND list_contains(dry, xor(a, d)))) > 0 THEN 2
          WHEN dry IS NULL THEN -1 ELSE {_REACHED} END AS pick FROM bm)"""


def coded(count: int = 12, letter: int = 83) -> str:
    """CTEs from px and var: coded(photo_id, variant, method, p, density, msg, i, v, v2)."""
    return f"""{variant_rows(count)},
img AS (SELECT photo_id, count(*) AS n_px, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY i))) AS h
        FROM px GROUP BY ALL),
job AS (SELECT *, greatest(2, (128 + greatest(p, 1) - 1) // greatest(p, 1)) * n AS head,
               (16 + 8 * msg + greatest(p, 1) - 1) // greatest(p, 1) AS need
        FROM (SELECT *, greatest((1 << p) - 1, 1) AS n,
                     CAST(CASE WHEN method = 'lsb' THEN floor(n_px * density / 8)
                          ELSE floor(greatest(1, n_px * p // greatest((1 << p) - 1, 1) // 8) * density) END AS BIGINT) AS msg
              FROM img CROSS JOIN var)),
pool AS (SELECT photo_id, variant, method, p, density, msg, h, n, need, i, v, i < head AS in_head,
                row_number() OVER (PARTITION BY photo_id, variant, i < head ORDER BY
                    substr(md5(CASE WHEN i < head THEN 'head:' ELSE substr(h, 1, 32) || ':' END || i // 4), CAST(8 * (i % 4) + 1 AS BIGINT), 8), i) - 1 AS r
         FROM job JOIN px USING (photo_id) WHERE method <> 'lsb'),
cell AS (SELECT *, r // n AS blk, row_number() OVER (PARTITION BY photo_id, variant, in_head, r // n ORDER BY i) AS j
         FROM pool WHERE in_head OR r < need * n),
bl AS (SELECT photo_id, variant, method, in_head, blk, any_value(msg) AS msg, any_value(h) AS h, any_value(p) AS p,
              bit_xor(CASE WHEN v % 2 = 1 THEN j ELSE 0 END) AS s,
              list(j ORDER BY j) FILTER (abs(v - 128) > 1) AS dry,
              coalesce(bit_or(CASE WHEN abs(v - 128) > 1 THEN 1 << (j - 1) END), 0) AS dm
       FROM cell GROUP BY ALL),
bm AS (SELECT *, CAST(xor(s, list_sum(list_transform(range(p), lambda q: (CASE
            WHEN in_head THEN CASE WHEN blk * p + q < 128 THEN
                 (CAST('0x' || substr(h, 2 * ((blk * p + q) // 8) + 1, 2) AS INTEGER) >> (7 - (blk * p + q) % 8)) & 1 ELSE 0 END
            WHEN blk * p + q < 16 THEN (msg >> (blk * p + q)) & 1
            WHEN blk * p + q < 16 + 8 * msg THEN ({letter} >> (7 - (blk * p + q - 16) % 8)) & 1 ELSE 0 END) << q))::BIGINT) AS BIGINT) AS d
       FROM bl),
bp AS (SELECT photo_id, variant, in_head, blk, d, CASE
          WHEN d = 0 THEN 0
          WHEN method = 'matrix' THEN -1
          WHEN list_contains(dry, d) THEN 1 << (d - 1)
          WHEN len(list_filter(dry, lambda a: a < xor(a, d) AND list_contains(dry, xor(a, d)))) > 0 THEN
            list_min(list_transform(list_filter(dry, lambda a: a < xor(a, d) AND list_contains(dry, xor(a, d))),
                     lambda a: a * 1000 + ((1 << (a - 1)) | (1 << (xor(a, d) - 1))))) % 1000
          ELSE coalesce(list_min(list_filter(range(1, 128), lambda m: (m & ~dm) = 0 AND {_xor_of_masks()}[m] = d)), -1)
          END AS pick FROM bm),
coded AS (
  SELECT photo_id, variant, method, p, density, msg, i, v, CAST(CASE
           WHEN pick = -1 AND j = d THEN xor(v, 1)
           WHEN pick > 0 AND (pick >> (j - 1)) & 1 = 1 THEN v - sign(v - 128) ELSE v END AS INTEGER) AS v2
  FROM cell JOIN bp USING (photo_id, variant, in_head, blk)
  UNION ALL
  SELECT photo_id, variant, method, p, density, msg, i, v, v FROM pool WHERE NOT in_head AND r >= need * n
  UNION ALL
  SELECT photo_id, variant, method, p, density, msg, i, v, CAST(CASE
           WHEN i < 16 THEN v - v % 2 + ((msg >> (15 - i)) & 1)
           WHEN i < 16 + 8 * msg THEN v - v % 2 + (({letter} >> (7 - (i - 16) % 8)) & 1) ELSE v END AS INTEGER)
  FROM job JOIN px USING (photo_id) WHERE method = 'lsb')"""
