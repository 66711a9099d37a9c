"""Shared SQL text for the DuckDB oracles (views: the parquet tables)."""

OC = """oc AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate,
         o.o_orderpriority, c.c_mktsegment, n.n_name, r.r_name
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

LP = """lp AS (
  SELECT l.*, p.p_name, p.p_brand, p.p_type, p.p_size
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

INDUSTRY = """CASE WHEN contains(lower({c}), 'auto') THEN 'automobile'
     WHEN contains(lower({c}), 'build') THEN 'building'
     WHEN contains(lower({c}), 'mach') THEN 'machinery' END"""


def industry(col: str = "c_mktsegment") -> str:
    return INDUSTRY.format(c=col)


def year(col: str) -> str:
    return f"CAST(year({col}) AS INTEGER)"


def month_index(col: str) -> str:
    return f"CAST(year({col}) * 12 + month({col}) - 1 AS INTEGER)"


def any_kw(col: str, kws) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{k}')" for k in kws) + ")"


def two_sided_p(z: str) -> str:
    """2 (1 - Phi(|z|)) = 1 - erf(|z| / sqrt 2) by the series
    erf(x) = exp(-x^2) sum_n x^(2n+1) / Gamma(n + 3/2), all terms positive."""
    x = f"(abs({z}) / sqrt(2))"
    return (f"CASE WHEN {z} IS NULL THEN NULL WHEN {x} > 8 THEN 0 WHEN {x} = 0 THEN 1 ELSE "
            f"1 - exp(-{x} * {x}) * list_sum(list_transform(range(0, 300), "
            f"lambda n: exp((2 * n + 1) * ln({x}) - lgamma(n + 1.5)))) END")
