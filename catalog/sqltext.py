"""Building blocks of the comparison SQL."""

from __future__ import annotations


def skew(c: str) -> str:
    return f"coalesce(case when count({c}) > 2 and min({c}) < max({c}) then skewness({c}) end, 0.0)"


def upper_tail(theta: str, d2: str, d1: str) -> str:
    """Tail of a beta law by Simpson's rule after t = cos^2, as a scalar subquery.

    Equals I_y(d2/2, d1/2) for theta = acos(sqrt(y)).
    """
    steps = 2000
    return f"""(select 2.0 * exp(lgamma(({d2})/2.0 + ({d1})/2.0) - lgamma(({d2})/2.0) - lgamma(({d1})/2.0))
        * sum((case when i in (0, {steps}) then 1.0 when i % 2 = 1 then 4.0 else 2.0 end)
              * pow(greatest(cos({theta} + i * h), 0.0), ({d2}) - 1.0) * pow(greatest(sin({theta} + i * h), 1e-300), ({d1}) - 1.0))
        * any_value(h) / 3.0
      from (select unnest(range(0, {steps + 1})) as i,
                   (least(pi() / 2, {theta} + 40.0 / sqrt({d2})) - ({theta})) / {steps} as h))"""


# Rational approximation of the normal quantile (Wichura's
# AS 241), numerators and denominators in ascending powers.
_MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_OUTER = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324),
)


def poly(coefs: tuple[float, ...], x: str) -> str:
    """A polynomial with coefficients in ascending powers."""
    text = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        text = f"({text} * {x} + {c!r}::double)"
    return text.replace(repr(coefs[-1]), f"{coefs[-1]!r}::double", 1)


def normal_quantile(p: str) -> str:
    """For 1e-11 < p < 1 - 1e-11."""
    middle, outer = f"(0.180625 - pow({p} - 0.5, 2))", f"(sqrt(-ln(least({p}, 1 - ({p})))) - 1.6)"
    return f"""case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {poly(_MIDDLE[0], middle)} / {poly(_MIDDLE[1], middle)}
        else sign({p} - 0.5) * {poly(_OUTER[0], outer)} / {poly(_OUTER[1], outer)} end"""


def normal_upper(z: str) -> str:
    """Upper tail of the normal law by Simpson's rule over its next 16 deviations."""
    return f"""list_sum(list_transform(range(0, 2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end)
        * exp(-pow({z} + i * 0.008, 2) / 2))) * 0.008 / 3 / sqrt(2 * pi())"""


def correlation_p(r: str, n: str) -> str:
    return f"case when abs({r}) >= 1 then 0.0 else {upper_tail(f'asin(least(1.0, abs({r})))', f'({n} - 2)', '1.0')} end"


def pairs(table: str, columns: list[str], least: int = 3) -> str:
    """(pair, a, b, n, r) of all column pairs."""
    parts, i = [], 0
    for x, a in enumerate(columns):
        for b in columns[x + 1 :]:
            parts.append(
                f"select {i} as pair, '{a}' as a, '{b}' as b, regr_count({a}, {b})::bigint as n, corr({a}, {b}) as r from {table}"
            )
            i += 1
    return f"select * from ({' union all '.join(parts)}) where n >= {least} and r is not null and not isnan(r)"


def strength(r: str) -> str:
    return (
        f"case when abs({r}) >= 0.7 then 'strong' when abs({r}) >= 0.4 then 'moderate' "
        f"when abs({r}) >= 0.2 then 'weak' else 'negligible' end"
    )


def title(c: str) -> str:
    """Title case of words of letters parted by blanks or underscores."""
    return (
        f"array_to_string(list_transform(string_split(lower(trim(replace({c}, '_', ' '))), ' '), "
        f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
    )


def outliers(table: str, c: str) -> str:
    """Scalar subquery: values outside 1.5 IQR."""
    return (
        f"(select count(*) filter (where q3 > q1 and (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))) from "
        f"(select {c}::double as v, (select quantile_cont({c}::double, 0.25) from {table}) as q1, "
        f"(select quantile_cont({c}::double, 0.75) from {table}) as q3 from {table}))"
    )


def profile(run: str, table: str, columns: list[tuple[str, str]]) -> str:
    """Column profile rows; kind is numeric, text or datetime."""
    parts = []
    for i, (c, kind) in enumerate(columns):
        role = {
            "numeric": "'numeric'",
            "datetime": "'datetime'",
            "text": f"case when count(distinct {c}) <= least(50, greatest(2, count(*) // 2)) then 'categorical' else 'text' end",
        }[kind]
        if kind == "numeric":
            figures = (
                f"min({c})::double as min, max({c})::double as max, avg({c}) as mean, quantile_cont({c}::double, 0.5) as median, "
                f"coalesce(stddev_samp({c}), 0.0) as std, {skew(c)} as skew, {outliers(table, c)} as outlier_count"
            )
        else:
            figures = "null as min, null as max, null as mean, null as median, null as std, null as skew, null as outlier_count"
        dates = (
            f"strftime(min({c}), '%Y-%m-%d %H:%M:%S') as min_date, strftime(max({c}), '%Y-%m-%d %H:%M:%S') as max_date"
            if kind == "datetime"
            else "null as min_date, null as max_date"
        )
        parts.append(
            f"select '{run}' as run_id, {i} as position, '{c}' as name, {role} as role, count(*) as n_rows, "
            f"count(*) - count({c}) as null_count, round((count(*) - count({c}))::double / count(*), 4) as null_pct, "
            f"count(distinct {c}) as distinct_count, {figures}, {dates} from {table}"
        )
    return " union all ".join(parts)


KEYWORDS = (
    "churn", "target", "label", "class", "outcome", "revenue", "sales", "price", "profit",
    "amount", "score", "rating", "conversion", "default", "fraud", "survived", "response", "y",
)


def is_target(c: str, mode: str) -> str:
    words = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
    if mode == "substring":
        return f"len(list_filter({words}, lambda k: contains(lower({c}), k))) > 0"
    return f"list_has_any(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), {words})"
