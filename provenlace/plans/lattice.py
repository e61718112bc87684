"""Exact analytics over a small, fully enumerated lattice of evidence sets."""

from __future__ import annotations

STEPS = 4
#: Atoms 0 to 7; atom a needs atoms under need[a]; utilities by atom.
BASE = """
atoms AS (SELECT n_nationkey AS a, @shl(n_nationkey) AS bit, CASE WHEN n_nationkey < 3 THEN CAST(0 AS BIGINT) ELSE @shl(n_nationkey % 3) END AS need,
          CAST((n_nationkey * 5) % 7 AS DOUBLE) / 10 AS u FROM nation WHERE n_nationkey < 8),
l0 AS (SELECT CAST(0 AS BIGINT) AS mask)"""


def _states() -> list[str]:
    """All closed sets of up to STEPS atoms: each is reached by adding its atoms after those they need."""
    return [
        BASE, "every AS (SELECT CAST(m AS BIGINT) AS mask FROM (SELECT @seq(0, 255) AS m FROM l0) x)",
        f"""state AS (SELECT e.mask, CAST(@bits(e.mask) AS INT) AS size FROM every e LEFT JOIN atoms a ON (e.mask & a.bit) <> 0 AND (a.need & ~e.mask) <> 0
  WHERE @bits(e.mask) <= {STEPS} AND a.a IS NULL)""",
    ]


def _grown() -> list[str]:
    """The same sets, grown atom by atom."""
    out = [BASE]
    for k in range(1, STEPS + 1):
        out.append(f"l{k} AS (SELECT DISTINCT l.mask | a.bit AS mask FROM l{k - 1} l JOIN atoms a ON (l.mask & a.bit) = 0 AND (a.need & ~l.mask) = 0)")
    return [*out, "state AS (" + " UNION ALL ".join(f"SELECT mask, {k} AS size FROM l{k}" for k in range(STEPS + 1)) + ")"]


def _layers(states: list[str]) -> str:
    out = [*states]
    out.append(f"step AS (SELECT s.mask AS parent, s.size, a.a AS action, s.mask | a.bit AS child FROM state s JOIN atoms a ON s.size < {STEPS} AND (s.mask & a.bit) = 0 AND (a.need & ~s.mask) = 0)")
    out.append("worth AS (SELECT s.mask, s.size, sum(CASE WHEN (s.mask & a.bit) <> 0 THEN a.u ELSE 0.0 END) AS u FROM state s JOIN atoms a ON true GROUP BY s.mask, s.size)")
    out.append("target AS (SELECT mask, size, u, exp(2 * u) / sum(exp(2 * u)) OVER () AS p FROM worth WHERE size >= 2)")
    return ",\n".join(out)


def _flow(states: list[str]) -> str:
    """Mass of the uniform policy, layer by layer: each legal add and, from size 2, stopping weigh the same."""
    out = [_layers(states), "deg AS (SELECT s.mask, s.size, count(t.action) AS adds, CASE WHEN s.size >= 2 THEN 1 ELSE 0 END AS stop FROM state s LEFT JOIN step t ON t.parent = s.mask GROUP BY s.mask, s.size)"]
    out.append("f0 AS (SELECT CAST(0 AS BIGINT) AS mask, CAST(1 AS DOUBLE) AS f)")
    for k in range(1, STEPS + 1):
        out.append(f"f{k} AS (SELECT t.child AS mask, sum(f.f / (d.adds + d.stop)) AS f FROM f{k - 1} f JOIN deg d ON d.mask = f.mask JOIN step t ON t.parent = f.mask GROUP BY t.child)")
    out.append("flow AS (" + " UNION ALL ".join(f"SELECT mask, f FROM f{k}" for k in range(STEPS + 1)) + ")")
    out.append("policy AS (SELECT d.mask, d.size, CASE WHEN d.stop = 1 THEN f.f / (d.adds + d.stop) ELSE 0.0 END AS q, f.f FROM flow f JOIN deg d ON d.mask = f.mask)")
    return ",\n".join(out)


def _plans(states: list[str]) -> dict[str, str]:
    return {
        "lattice_states": f"WITH {_layers(states)} SELECT mask, CAST(size AS BIGINT) AS size FROM state",
        "lattice_transitions": f"WITH {_layers(states)} SELECT parent, action, child FROM step",
        "lattice_terminals": f"WITH {_layers(states)} SELECT mask, round(u, 6) AS utility FROM worth WHERE size >= 2",
        "lattice_fingerprints": f"WITH {_layers(states)} SELECT @sha(@saggby(CAST(mask AS STRING), ',', mask)) AS fingerprint FROM state",
        "target_distribution": f"WITH {_layers(states)} SELECT mask, round(p, 9) AS p FROM target",
        "target_by_beta": f"""WITH {_layers(states)},
b AS (SELECT r_regionkey + 1 AS beta FROM region)
SELECT beta, mask, round(exp(beta * u) / sum(exp(beta * u)) OVER (PARTITION BY beta), 9) AS p FROM worth JOIN b ON size >= 2""",
        "policy_uniform_mass": f"WITH {_flow(states)} SELECT mask, round(q, 9) AS mass FROM policy WHERE q > 0",
        "partition_residual": f"WITH {_flow(states)} SELECT round(1 - sum(q), 9) AS residual FROM policy",
        "uniform_backward": f"WITH {_layers(states)} SELECT child, parent, round(1.0 / count(*) OVER (PARTITION BY child), 9) AS p FROM step",
        "divergence_tv_js_kl": f"""WITH {_flow(states)},
pq AS (SELECT coalesce(t.mask, p.mask) AS mask, coalesce(t.p, 0.0) AS p, coalesce(p.q, 0.0) AS q FROM target t FULL JOIN (SELECT * FROM policy WHERE q > 0) p ON p.mask = t.mask)
SELECT round(0.5 * sum(abs(p - q)), 6) AS tv, CASE WHEN bool_or(p > 0 AND q = 0) THEN NULL ELSE round(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0.0 END), 6) END AS kl,
       round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0.0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0.0 END), 6) AS js FROM pq""",
        "mass_profile": f"""WITH {_layers(states)}
SELECT round(max(p), 6) AS mode_mass, round(exp(sum(-p * ln(p))), 6) AS effective_support, round(sum(CASE WHEN rn <= 10 THEN p ELSE 0.0 END), 6) AS top10, count(*) AS support
FROM (SELECT p, row_number() OVER (ORDER BY p DESC, mask) AS rn FROM target) t""",
        "best_of_k_ceiling": f"""WITH {_layers(states)},
c AS (SELECT u, sum(p) OVER (ORDER BY u, mask ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, p FROM target),
k AS (SELECT CAST(power(2, r_regionkey) AS BIGINT) AS k FROM region WHERE r_regionkey < 4)
SELECT k, round(sum(u * (power(least(f, 1.0), k) - power(greatest(f - p, 0.0), k))), 6) AS best FROM c JOIN k ON true GROUP BY k""",
        "audit_dead_and_closed": f"""WITH {_layers(states)}
SELECT count(CASE WHEN t.parent IS NULL AND s.size < {STEPS} THEN 1 END) AS dead_ends, count(DISTINCT s.mask) AS states FROM state s LEFT JOIN step t ON t.parent = s.mask""",
        "topological_levels": f"WITH {_layers(states)} SELECT a AS atom, CASE WHEN need = 0 THEN 0 ELSE 1 END AS level FROM atoms",
        "trajectory_balance_residual": f"""WITH {_flow(states)},
w AS (SELECT t.parent, t.child, -ln(CAST(d.adds + d.stop AS DOUBLE)) AS pf, -ln(CAST(count(*) OVER (PARTITION BY t.child) AS DOUBLE)) AS pb FROM step t JOIN deg d ON d.mask = t.parent)
SELECT parent, child, round(pf - pb, 6) AS residual FROM w""",
    }


PLANS, PLAIN = _plans(_states()), _plans(_grown())
