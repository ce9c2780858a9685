"""Tail probabilities as SQL expressions.

Each function takes the SQL text of its arguments and returns the SQL text of
the result, for ``F.expr`` / ``selectExpr``: the work stays in the JVM and is done
on the few rows that hold a test's sufficient statistics. Arguments that are
used more than once are bound to a lambda variable first. ``Duck`` writes the
same expressions for the SQL checks.

Accurate for any number of rows: log-beta is taken from Stirling remainders
instead of differences of large log-gammas.
"""

from __future__ import annotations

import math

# --- fixed values: published coefficients ------------------------------------
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012,
           9.9843695780195716e-6, 1.5056327351493116e-7)
NORMAL_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
NORMAL_SHOULDER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
NORMAL_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))
HALF_LOG_2PI = 0.91893853320467274178
# -----------------------------------------------------------------------------

TINY = "1e-300"


def num(x: float) -> str:
    """A double literal in either dialect."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def horner(coefficients, x: str) -> str:
    """Polynomial with ascending ``coefficients`` at ``x``."""
    out = num(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({num(c)} + {x} * {out})"
    return out


class Spark:
    """Expressions in Spark SQL."""

    def let(self, name: str, value: str, body: str) -> str:
        return f"get(transform(array({value}), {name} -> {body}), 0)"

    def record(self, fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def fold(self, steps: str, start: dict[str, str], s: str, m: str, step: str, result: str) -> str:
        """Run ``step`` for ``m`` = 1 … ``steps`` on the record ``s``; its field ``result``."""
        begin = self.record({k: f"CAST({v} AS DOUBLE)" for k, v in start.items()})
        return f"aggregate(sequence(1, CAST({steps} AS INT)), {begin}, ({s}, {m}) -> {step}, {s} -> {s}.{result})"


class Duck(Spark):
    """The same expressions in DuckDB's SQL."""

    def let(self, name, value, body):
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def record(self, fields):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def fold(self, steps, start, s, m, step, result):
        begin = self.record({"m_": "0.0::DOUBLE"} | {k: f"CAST({v} AS DOUBLE)" for k, v in start.items()})
        blank = self.record({"m_": "CAST(i_ AS DOUBLE)"} | {k: "0.0::DOUBLE" for k in start})
        # every record carries its step number, which DuckDB's fold has no other way to pass
        numbered = step.replace("{'", "{'m_': " + f"{m}_.m_, '", 1) if step.startswith("{'") else step
        body = self.let(m, f"{m}_.m_", "@@")
        if step.startswith("{'"):
            body = body.replace("@@", numbered)
        else:
            head, _, tail = step.rpartition("{'")
            body = body.replace("@@", head + "{'m_': " + f"{m}_.m_, '" + tail)
        return (f"list_reduce(list_transform(range(1, CAST({steps} AS BIGINT) + 1), lambda i_: {blank}), "
                f"lambda {s}, {m}_: {body}, {begin}).{result}")


SPARK, DUCK = Spark(), Duck()


def log_gamma(z: str) -> str:
    """log Γ(z) for z ≥ 0.5 (Lanczos)."""
    series = num(LANCZOS[0]) + "".join(f" + {num(c)} / ({z} - 1e0 + {i}e0)" for i, c in enumerate(LANCZOS[1:], 1))
    return f"({num(HALF_LOG_2PI)} + ({z} - 0.5e0) * ln({z} + 6.5e0) - ({z} + 6.5e0) + ln({series}))"


def stirling_rest(x: str) -> str:
    return f"(1e0 / (12e0 * {x}) - 1e0 / (360e0 * power({x}, 3)) + 1e0 / (1260e0 * power({x}, 5)) - 1e0 / (1680e0 * power({x}, 7)))"


def log1m(x: str) -> str:
    """log(1 − x), exact to rounding for small x."""
    series = f"(-{x} * (1e0 + {x} * (0.5e0 + {x} * (1e0 / 3e0 + {x} * (0.25e0 + {x} * 0.2e0)))))"
    return f"(CASE WHEN {x} < 1e-4 THEN {series} ELSE ln(1e0 - {x}) END)"


def log_beta(a: str, b: str, d: Spark = SPARK) -> str:
    p, q, t = "lb_.p", "lb_.q", "(lb_.p + lb_.q)"
    both = (f"{num(HALF_LOG_2PI)} - 0.5e0 * ln({q}) + {stirling_rest(p)} + {stirling_rest(q)} - {stirling_rest(t)} "
            f"+ ({p} - 0.5e0) * ln({p} / {t}) + {q} * {log1m(f'({p} / {t})')}")
    one = (f"{log_gamma(p)} + {stirling_rest(q)} - {stirling_rest(t)} + {p} - {p} * ln({t}) "
           f"+ ({q} - 0.5e0) * {log1m(f'({p} / {t})')}")
    none = f"{log_gamma(p)} + {log_gamma(q)} - {log_gamma(t)}"
    return d.let("lb_", d.record({"p": f"least({a}, {b})", "q": f"greatest({a}, {b})"}),
                 f"CASE WHEN {p} >= 10e0 THEN {both} WHEN {q} >= 10e0 THEN {one} ELSE {none} END")


def away_from_zero(v: str, d: Spark, name: str) -> str:
    return d.let(name, v, f"CASE WHEN abs({name}) < {TINY} THEN {TINY} ELSE {name} END")


def beta_fraction(d: Spark) -> str:
    """Continued fraction of the incomplete beta for the record ``bi_`` (a, b, x)."""
    a, b, x = "bi_.a", "bi_.b", "bi_.x"
    odd = f"(m_bf * ({b} - m_bf) * {x} / (({a} + 2e0 * m_bf - 1e0) * ({a} + 2e0 * m_bf)))"
    even = f"(-({a} + m_bf) * ({a} + {b} + m_bf) * {x} / (({a} + 2e0 * m_bf) * ({a} + 2e0 * m_bf + 1e0)))"

    def half(coefficient, prev):
        return d.record({"d": f"1e0 / {away_from_zero(f'(1e0 + {coefficient} * {prev}.d)', d, 'z_')}",
                         "c": away_from_zero(f"(1e0 + {coefficient} / {prev}.c)", d, "z_")})

    step = d.let("u_", half(odd, "s_bf"), d.let("w_", half(even, "u_"), d.record(
        {"c": "w_.c", "d": "w_.d", "h": "s_bf.h * u_.d * u_.c * w_.d * w_.c"})))
    first = f"1e0 / {away_from_zero(f'(1e0 - ({a} + {b}) * {x} / ({a} + 1e0))', d, 'z_')}"
    steps = f"(50e0 + 3e0 * sqrt(least({a}, {b})))"
    return d.fold(steps, {"c": "1e0", "d": first, "h": first}, "s_bf", "m_bf", step, "h")


def beta_inc(a: str, b: str, x: str, xc: str, d: Spark = SPARK) -> str:
    """Regularised incomplete beta I_x(a, b); ``xc`` is 1 − x, given apart for accuracy."""
    swap = "(bx_.x > (bx_.a + 1e0) / (bx_.a + bx_.b + 2e0))"
    chosen = d.record({"a": f"CASE WHEN {swap} THEN bx_.b ELSE bx_.a END", "b": f"CASE WHEN {swap} THEN bx_.a ELSE bx_.b END",
                       "x": f"CASE WHEN {swap} THEN bx_.xc ELSE bx_.x END", "xc": f"CASE WHEN {swap} THEN bx_.x ELSE bx_.xc END"})
    log_xc = f"(CASE WHEN bi_.x < 0.5e0 THEN {log1m('bi_.x')} ELSE ln(bi_.xc) END)"
    front = f"exp(bi_.a * ln(bi_.x) + bi_.b * {log_xc} - {log_beta('bi_.a', 'bi_.b', d)}) / bi_.a"
    inner = d.let("bi_", chosen, f"{front} * {beta_fraction(d)}")
    value = d.let("v_", inner, f"CASE WHEN {swap} THEN 1e0 - v_ ELSE v_ END")
    body = f"CASE WHEN bx_.x <= 0e0 THEN 0e0 WHEN bx_.xc <= 0e0 THEN 1e0 ELSE {value} END"
    return d.let("bx_", d.record({"a": f"CAST({a} AS DOUBLE)", "b": f"CAST({b} AS DOUBLE)",
                                  "x": f"CAST({x} AS DOUBLE)", "xc": f"CAST({xc} AS DOUBLE)"}), body)


def horner_series(m: str, terms: int = 10) -> str:
    """1/2 - m/3 + m^2/4 - ..., the series of (m - ln(1 + m)) / m^2."""
    out = num((-1) ** terms / (terms + 2))
    for k in range(terms - 1, -1, -1):
        out = f"({num((-1) ** k / (k + 2))} + {m} * {out})"
    return out


def gamma_upper(a: str, x: str, d: Spark = SPARK) -> str:
    """Regularised upper incomplete gamma Q(a, x).

    Series and continued fraction up to a = 10^4. Beyond, the first term of
    Temme's uniform expansion, Q(a, x) = Q(1/2, y) / 2 or its complement plus a
    correction, with y = a (m - ln(1 + m)) and m = x / a - 1; what it leaves out
    is below 0.002 / a^1.5, so 2e-9, for every x.
    """
    m = "((gx_.x - gx_.a) / gx_.a)"
    near = f"({m} * {m} * (" + horner_series(m) + "))"
    spread = f"(CASE WHEN abs({m}) < 1e-2 THEN {near} ELSE {m} - ln(gx_.x / gx_.a) END)"
    large = "(gx_.a > 1e4 AND gx_.x > 0e0)"
    given = d.record({"a": f"CASE WHEN {large} THEN 0.5e0 ELSE gx_.a END", "big": f"CASE WHEN {large} THEN gx_.a ELSE 0e0 END",
                      "x": f"CASE WHEN {large} THEN gx_.a * {spread} ELSE gx_.x END", "m": f"CASE WHEN {large} THEN {m} ELSE 0e0 END"})
    front = f"exp(-g_.x + g_.a * ln(g_.x) - {log_gamma('g_.a')})"
    steps = "(120e0 + 12e0 * sqrt(g_.a))"
    series = d.fold(steps, {"t": "1e0 / g_.a", "v": "1e0 / g_.a"}, "s_g", "m_g",
                    d.let("t_", "s_g.t * g_.x / (g_.a + m_g)", d.record({"t": "t_", "v": "s_g.v + t_"})), "v")
    an, bn = "(-m_g * (m_g - g_.a))", "(g_.x + 1e0 - g_.a + 2e0 * m_g)"
    half = d.record({"d": f"1e0 / {away_from_zero(f'({an} * s_g.d + {bn})', d, 'z_')}",
                     "c": away_from_zero(f"({bn} + {an} / s_g.c)", d, "z_")})
    fraction = d.fold(steps, {"c": "1e300", "d": "1e0 / (g_.x + 1e0 - g_.a)", "h": "1e0 / (g_.x + 1e0 - g_.a)"},
                      "s_g", "m_g", d.let("u_", half, d.record({"c": "u_.c", "d": "u_.d", "h": "s_g.h * u_.d * u_.c"})), "h")
    body = (f"CASE WHEN g_.x <= 0e0 THEN 1e0 WHEN g_.x < g_.a + 1e0 THEN 1e0 - {front} * {series} "
            f"ELSE {front} * {fraction} END")
    eta = "(sign(g_.m) * sqrt(2e0 * g_.x / g_.big))"
    first = d.let("e_", eta, "(CASE WHEN abs(g_.m) < 1e-2 THEN -1e0 / 3e0 + e_ * (1e0 / 12e0 + e_ * (-2e0 / 135e0 + e_ * (1e0 / 864e0 "
                             "+ e_ / 2835e0))) ELSE 1e0 / g_.m - 1e0 / e_ END)")
    rest = f"exp(-g_.x) / sqrt({num(2 * math.pi)} * g_.big) * {first}"
    value = d.let("q_", body, f"CASE WHEN g_.big = 0e0 THEN q_ WHEN g_.m >= 0e0 THEN 0.5e0 * q_ + {rest} ELSE 1e0 - 0.5e0 * q_ + {rest} END")
    return d.let("gx_", d.record({"a": f"CAST({a} AS DOUBLE)", "x": f"CAST({x} AS DOUBLE)"}), d.let("g_", given, value))


def f_sf(f: str, d1: str, d2: str, d: Spark = SPARK) -> str:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return beta_inc(f"({d2}) / 2e0", f"({d1}) / 2e0", f"({d2}) / (({d2}) + ({d1}) * ({f}))",
                    f"({d1}) * ({f}) / (({d2}) + ({d1}) * ({f}))", d)


def r_pvalue(r: str, n: str, d: Spark = SPARK) -> str:
    """Two-sided p of a correlation over n pairs (Student t with n − 2)."""
    body = beta_inc(f"({n} - 2) / 2e0", "0.5e0", f"1e0 - ({r}) * ({r})", f"({r}) * ({r})", d)
    return f"CASE WHEN {n} > 2 THEN {body} END"


def chi2_sf(x: str, k: str, d: Spark = SPARK) -> str:
    return gamma_upper(f"({k}) / 2e0", f"({x}) / 2e0", d)


def normal_two_sided(z: str, d: Spark = SPARK) -> str:
    return gamma_upper("0.5e0", f"({z}) * ({z}) / 2e0", d)


def normal_upper(z: str, d: Spark = SPARK) -> str:
    return d.let("nz_", z, f"CASE WHEN nz_ >= 0 THEN 0.5e0 * {normal_two_sided('nz_', d)} "
                           f"ELSE 1e0 - 0.5e0 * {normal_two_sided('nz_', d)} END")


def normal_quantile(p: str, d: Spark = SPARK) -> str:
    """Inverse normal distribution function (rational approximations, 16 digits)."""
    def ratio(pair, x):
        return f"{horner(pair[0], x)} / {horner(pair[1], x)}"

    q = "(np_ - 0.5e0)"
    centre = f"{q} * {ratio(NORMAL_CENTRE, f'(0.180625e0 - {q} * {q})')}"
    tail = d.let("r_", "sqrt(-ln(least(np_, 1e0 - np_)))",
                 f"(CASE WHEN r_ <= 5e0 THEN {ratio(NORMAL_SHOULDER, '(r_ - 1.6e0)')} "
                 f"ELSE {ratio(NORMAL_TAIL, '(r_ - 5e0)')} END)")
    return d.let("np_", p, f"CASE WHEN abs({q}) <= 0.425e0 THEN {centre} "
                           f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END")


def kolmogorov_sf(lam: str, d: Spark = SPARK) -> str:
    """Limiting distribution of the scaled K-S distance."""
    term = "2e0 * (2e0 * (m_k % 2e0) - 1e0) * exp(-2e0 * m_k * m_k * k_.l * k_.l)"
    total = d.fold("100", {"v": "0e0"}, "s_k", "m_k", d.record({"v": f"s_k.v + {term}"}), "v")
    return d.let("k_", d.record({"l": lam}), f"CASE WHEN k_.l < 0.2e0 THEN 1e0 ELSE least(1e0, greatest(0e0, {total})) END")


def noncentral_f_cdf(f: str, d1: str, d2: str, ncp: str, d: Spark = SPARK) -> str:
    """P(F' ≤ f): Poisson mixture of incomplete betas, each from its neighbour.

    The sum starts at the mode of the Poisson weights and walks both ways for 12
    of their standard deviations and 60 terms more, so nothing underflows. The
    betas fall below rounding after ``last`` terms, so it starts there at most.
    """
    mean = f"(({d1}) * ({f}) / 2e0)"
    last = f"(60e0 + {mean} + 12e0 * sqrt({mean}))"
    k = f"floor(least(({ncp}) / 2e0, {last}))"
    given = d.record({"a": f"CAST(({d1}) AS DOUBLE) / 2e0 + {k}", "b": f"CAST(({d2}) AS DOUBLE) / 2e0",
                      "y": f"greatest(1e-300, ({d1}) * ({f}) / (({d2}) + ({d1}) * ({f})))", "yc": f"({d2}) / (({d2}) + ({d1}) * ({f}))",
                      "l": f"CAST(({ncp}) AS DOUBLE) / 2e0", "k": f"CAST({k} AS DOUBLE)", "s": f"least({last}, 60e0 + 12e0 * sqrt(({ncp}) / 2e0))"})
    start = d.record({"a": "nc_.a", "b": "nc_.b", "y": "nc_.y", "l": "nc_.l", "k": "nc_.k", "s": "nc_.s",
                      "i": beta_inc("nc_.a", "nc_.b", "nc_.y", "nc_.yc", d),
                      "t": f"exp(nc_.a * ln(nc_.y) + nc_.b * {log1m('nc_.y')} - {log_beta('nc_.a', 'nc_.b', d)}) / nc_.a",
                      "w": f"CASE WHEN nc_.l <= 0e0 THEN 1e0 ELSE exp(nc_.k * ln(nc_.l) - nc_.l - {log_gamma('(nc_.k + 1e0)')}) END"})
    # the m-th step adds the terms m - 1 above and m below the mode; a counts from the mode
    down = d.record({"t": "CASE WHEN m_n <= n0_.k THEN s_n.dt * (n0_.a - m_n + 1e0) / (n0_.y * (n0_.a + n0_.b - m_n)) ELSE 0e0 END",
                     "w": "CASE WHEN m_n <= n0_.k THEN s_n.dw * (n0_.k - m_n + 1e0) / n0_.l ELSE 0e0 END"})
    step = d.let("dn_", down, d.record({
        "v": "s_n.v + s_n.w * s_n.i + dn_.w * least(1e0, s_n.di + dn_.t)",
        "i": "greatest(0e0, s_n.i - s_n.t)", "t": "s_n.t * n0_.y * (n0_.a + n0_.b + m_n - 1e0) / (n0_.a + m_n)",
        "w": "s_n.w * n0_.l / (n0_.k + m_n)", "di": "least(1e0, s_n.di + dn_.t)", "dt": "dn_.t", "dw": "dn_.w"}))
    total = d.fold("n0_.s", {"v": "0e0", "i": "n0_.i", "t": "n0_.t", "w": "n0_.w", "di": "n0_.i", "dt": "n0_.t", "dw": "n0_.w"},
                   "s_n", "m_n", step, "v")
    return d.let("nc_", given, d.let("n0_", start, f"least(1e0, {total})"))


def bisect(lo: str, hi: str, steps: int, below, d: Spark = SPARK) -> str:
    """Point between ``lo`` and ``hi`` where ``below(x)`` turns from true to false."""
    step = d.let("x_b", "(s_b.lo + s_b.hi) / 2e0", d.let("y_b", f"CASE WHEN {below('x_b')} THEN 1e0 ELSE 0e0 END", d.record(
        {"lo": "CASE WHEN y_b > 0.5e0 THEN x_b ELSE s_b.lo END", "hi": "CASE WHEN y_b > 0.5e0 THEN s_b.hi ELSE x_b END"})))
    return d.fold(str(steps), {"lo": lo, "hi": hi}, "s_b", "m_b", step, "lo")
