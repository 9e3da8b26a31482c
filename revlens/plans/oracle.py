"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The SQL is assembled from named CTE fragments with dependencies; ``sql(deps,
body)`` emits ``WITH`` + every needed fragment in dependency order + ``body``.
Doubles are rounded to 6 places on both sides (``log1p`` vs ``ln`` differ in
the last digit).
"""

from __future__ import annotations

from revlens.functions import constants as K
from revlens.operators import risk as RK
from revlens.sources.tables import BASE_SQL, RAW_REVIEWS_SQL, REVIEWS_SQL

_CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    _CTES[name] = (deps, body)


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str):
        if n in out:
            return
        for d in _CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(deps: list[str], body: str) -> str:
    names = _order(deps)
    parts = [f"{n} as ({_CTES[n][1]})" for n in names]
    return ("with " + ",\n".join(parts) + "\n" + body) if parts else body


# ---- expression helpers ---------------------------------------------------------------
def clip(x: str, lo: float, hi: float) -> str:
    return f"(case when ({x}) < {lo} then {lo}::double when ({x}) > {hi} then {hi}::double " \
           f"else ({x}) end)"


def clip01(x: str) -> str:
    return clip(x, 0.0, 1.0)


def log1p(x: str) -> str:
    return f"(case when ({x}) > -1 then ln(1 + ({x})) end)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def to_double(x: str) -> str:
    return f"try_cast({x} as double)"


def flag(x: str) -> str:
    return f"coalesce(cast(cast({x} as boolean) as integer), 0)"


def r6(x: str) -> str:
    """Same two-step rounding as ``columns.round6``."""
    return f"(round_even(round_even(({x}) * 1e9::double, 0) / 1e3::double, 0) / 1e6::double)"


def msum(x: str) -> str:
    """Exact sum of amounts, as ``columns.money_sum``."""
    return f"cast(sum(cast({x} as decimal(38, 6))) as double)"


def mavg(x: str) -> str:
    return f"({msum(x)} / nullif(cast(count({x}) as double), 0))"


def trunc_money(x: str) -> str:
    return f"cast(trunc({x}) as bigint)"


def minmax0(x: str, mn: str, mx: str) -> str:
    return f"(case when {mx} = {mn} then 0.0::double else {clip01(f'(({x}) - {mn}) / ({mx} - {mn} + 1e-9)')} end)"


def sentiment_map(x: str, mapping: dict, default: float = 0.5) -> str:
    whens = " ".join(f"when {x} = '{k}' then {v}::double" for k, v in mapping.items())
    return f"(case {whens} else {default}::double end)"


def recency_plateau(d: str) -> str:
    adj = f"(case when {d} - 10 > 0 then {d} - 10 when {d} is not null then 0.0 end)"
    return clip01(f"exp(-{adj} / 30.0)")


def severity(rating: str) -> str:
    return clip01(f"0.6 * {clip01(f'(5.0 - {rating}) / 4.0')} + 0.4 * 0.5")


def category(text: str) -> str:
    t = f"lower(coalesce(cast({text} as varchar), ''))"
    whens = " ".join(f"when regexp_matches({t}, '{'|'.join(words)}') then '{name}'"
                     for name, words in K.ISSUE_KEYWORDS)
    return f"(case {whens} else 'Other' end)"


def cis(prefix: str = "") -> str:
    w = K.CIS_WEIGHTS
    p = prefix
    return clip01(f"{w['ltv_norm']} * {p}ltv_norm + {w['order_norm']} * {p}order_norm + "
                  f"{w['repeat']} * {p}repeat + {w['verified']} * {p}verified + "
                  f"{w['helpful_norm']} * {p}helpful_norm + {w['recency_score']} * {p}recency_score")


def rounded(cols: dict[str, str], doubles: set[str]) -> str:
    """Select list: ``expr as name``, doubles rounded to 6 places."""
    return ", ".join(f"{r6(e) if n in doubles else e} as \"{n}\"" for n, e in cols.items())


def select_round(table: str, cols: list[str], doubles: set[str], where: str = "") -> str:
    body = ", ".join(f"{r6(chr(34) + c + chr(34)) if c in doubles else chr(34) + c + chr(34)} "
                     f"as \"{c}\"" for c in cols)
    return f"select {body} from {table}" + (f" where {where}" if where else "")


# ---- review chain -------------------------------------------------------------------
cte("base", [], BASE_SQL)
cte("reviews", [], REVIEWS_SQL)
cte("raw", [], RAW_REVIEWS_SQL)

NORM_COLS = ["product", "rating", "review_text", "sentiment", "customer_ltv", "order_value",
             "days_since_purchase", "helpful_votes", "is_repeat_customer", "verified_purchase",
             "review_date", "sentiment_score"]

cte("norm", ["reviews"], f"""select {strip("coalesce(cast(product as varchar), 'Unknown')")} as product,
 coalesce({to_double('rating')}, 0.0) as rating, cast(review_text as varchar) as review_text,
 sentiment, coalesce({to_double('customer_ltv')}, 0.0) as customer_ltv,
 coalesce({to_double('order_value')}, 0.0) as order_value,
 coalesce({to_double('days_since_purchase')}, 0.0) as days_since_purchase,
 coalesce({to_double('helpful_votes')}, 0.0) as helpful_votes,
 {flag('is_repeat_customer')} as is_repeat_customer, {flag('verified_purchase')} as verified_purchase,
 review_date, 0.0::double as sentiment_score
from reviews where {strip("coalesce(cast(product as varchar), 'Unknown')")} <> ''""")


def scored_chain(name: str, src: str, extra_cols: list[str], sentiment_col: bool = False) -> None:
    """scored reviews CTE ``name`` from a normalised CTE ``src``.
    ``extra_cols`` are carried through unchanged."""
    carry = ", ".join(f'"{c}"' for c in extra_cols)
    carry = (carry + ", ") if carry else ""
    cte(f"{name}_prep", [src], f"""select {carry}
 coalesce({to_double('customer_ltv')}, 0.0) as customer_ltv,
 coalesce({to_double('order_value')}, 0.0) as order_value,
 coalesce({to_double('helpful_votes')}, 0.0) as helpful_votes,
 coalesce({to_double('days_since_purchase')}, 30.0) as days_since_purchase,
 {to_double('rating')} as rating0, cast(review_text as varchar) as review_text,
 is_repeat_customer, verified_purchase,
 {log1p("coalesce(" + to_double('customer_ltv') + ", 0.0)")} as ltv_log,
 {log1p("coalesce(" + to_double('order_value') + ", 0.0)")} as order_value_log
from {src}""")
    cte(f"{name}_st", [f"{name}_prep"], f"""select min(ltv_log) mn_l, max(ltv_log) mx_l,
 min(order_value_log) mn_o, max(order_value_log) mx_o, min(helpful_votes) mn_h,
 max(helpful_votes) mx_h from {name}_prep""")
    sev = severity("rating") if not sentiment_col else clip01(
        f"0.6 * {clip01('(5.0 - rating) / 4.0')} + 0.4 * {sentiment_map('sentiment', K.SENTIMENT_SEVERITY)}")
    cte(f"{name}_s1", [f"{name}_prep", f"{name}_st"], f"""select p.* exclude (rating0),
 {clip('rating0', 1.0, 5.0)} as rating,
 {minmax0('ltv_log', 'mn_l', 'mx_l')} as ltv_norm,
 {minmax0('order_value_log', 'mn_o', 'mx_o')} as order_norm,
 {minmax0('helpful_votes', 'mn_h', 'mx_h')} as helpful_norm,
 {flag('is_repeat_customer')} as repeat, {flag('verified_purchase')} as verified
from {name}_prep p cross join {name}_st""")
    cte(f"{name}_s2", [f"{name}_s1"], f"""select *,
 coalesce(cast(rating <= 2 as integer), 0) as is_negative,
 {recency_plateau('days_since_purchase')} as recency_score,
 {sev} as issue_severity from {name}_s1""")
    cte(f"{name}_s3", [f"{name}_s2"], f"""select *, {cis()} as "CIS" from {name}_s2""")
    cte(f"{name}_s4", [f"{name}_s3"], f"""select *,
 {clip01('case when rating <= 3 then "CIS" * issue_severity else 0.0 end')} as impact_score,
 {category('review_text')} as issue_category from {name}_s3""")


SCORED_NUM = ["rating", "customer_ltv", "order_value", "days_since_purchase", "helpful_votes",
              "ltv_log", "order_value_log", "ltv_norm", "order_norm", "helpful_norm", "repeat",
              "verified", "is_negative", "recency_score", "issue_severity", "CIS", "impact_score"]


def scored_final(name: str, numeric_extra: list[str], other_extra: list[str]) -> None:
    nums = SCORED_NUM + numeric_extra
    cols = [f'coalesce("{c}", 0) as "{c}"' for c in nums]
    cols += [f'"{c}"' for c in other_extra + ["review_text", "issue_category"]]
    cte(name, [f"{name}_s4"], f"select {', '.join(cols)} from {name}_s4")


scored_chain("scored", "norm", ["product", "sentiment", "sentiment_score", "review_date"])
scored_final("scored", ["sentiment_score", "is_repeat_customer", "verified_purchase"],
             ["product", "sentiment", "review_date"])

SCORED_COLS = SCORED_NUM + ["sentiment_score", "is_repeat_customer", "verified_purchase",
                            "product", "sentiment", "review_date", "review_text",
                            "issue_category"]
SCORED_DOUBLES = set(SCORED_NUM + ["sentiment_score"]) - {"repeat", "verified", "is_negative"}


# ---- product chain --------------------------------------------------------------------
def product_chain(name: str, scored: str) -> None:
    cte(f"{name}_m", [scored], f"""select product,
 sum(impact_score) as total_impact, avg(rating) as avg_rating, avg(repeat) as repeat_rate,
 {mavg('customer_ltv')} as avg_customer_ltv, {msum('customer_ltv')} as total_ltv,
 {mavg('order_value')} as avg_order_value, count(*) as total_reviews,
 cast(count_if(rating <= 2.5) as bigint) as negative_count,
 coalesce({msum('case when rating <= 2.5 then customer_ltv end')}, 0.0) as total_revenue_at_risk
from (select * exclude (product, customer_ltv),
        {strip("coalesce(cast(product as varchar), 'Unknown')")} as product,
        coalesce({to_double('customer_ltv')}, 0.0) as customer_ltv from {scored})
where product <> '' group by product""")
    cte(f"{name}_m2", [f"{name}_m"], f"""select *, negative_count / total_reviews as negative_ratio,
 total_revenue_at_risk as revenue_at_risk, 5.0 - avg_rating as rating_drop from {name}_m""")
    cte(f"{name}_pst", [f"{name}_m2"], f"""select
 min(cast(total_reviews as double)) a1, max(cast(total_reviews as double)) b1,
 min(avg_order_value) a2, max(avg_order_value) b2, min(repeat_rate) a3, max(repeat_rate) b3,
 min(rating_drop) a4, max(rating_drop) b4, min(negative_ratio) a5, max(negative_ratio) b5
from {name}_m2""")
    w = K.PPS_WEIGHTS
    pps = clip01(f"{w['freq']} * {minmax0('cast(total_reviews as double)', 'a1', 'b1')} + "
                 f"{w['order']} * {minmax0('avg_order_value', 'a2', 'b2')} + "
                 f"{w['repeat']} * {minmax0('repeat_rate', 'a3', 'b3')} + "
                 f"{w['rating_drop']} * {minmax0('rating_drop', 'a4', 'b4')} + "
                 f"{w['negative']} * {minmax0('negative_ratio', 'a5', 'b5')}")
    cte(f"{name}_pps", [f"{name}_m2", f"{name}_pst"], f"""select m.* exclude (rating_drop),
 {pps} as "PPS" from {name}_m2 m cross join {name}_pst""")
    cte(name, [f"{name}_pps"], f"""select *, {log1p('total_impact')} * (1 + "PPS") as final_score
 from {name}_pps""")
    cte(f"{name}_q75", [name], f"""select quantile_cont(total_revenue_at_risk, 0.75) pr,
 quantile_cont(negative_ratio, 0.75) pn, quantile_cont(total_impact, 0.75) pi from {name}""")
    quad = ("case when total_revenue_at_risk > pr and negative_ratio > pn then 'The Fire-Fight' "
            "when total_impact > pi and negative_ratio < pn then 'The VIP Nudge' "
            "when total_revenue_at_risk < pr and negative_ratio > pn then 'The Slow Burn' "
            "else 'The Noise' end")
    cte(f"{name}_quad0", [name, f"{name}_q75"], f"""select p.*, {quad} as quadrant
 from {name} p cross join {name}_q75""")
    acts = " ".join(f"when quadrant = '{q}' then '{a}'" for q, a in K.QUADRANT_ACTIONS.items())
    cte(f"{name}_quad", [f"{name}_quad0"], f"""select *, case {acts} end as action,
 case when quadrant in ('The Fire-Fight', 'The VIP Nudge') then 'High' else 'Low' end as priority
 from {name}_quad0""")


product_chain("products", "scored")

PRODUCT_COLS = ["product", "total_impact", "avg_rating", "repeat_rate", "avg_customer_ltv",
                "total_ltv", "avg_order_value", "total_reviews", "negative_count",
                "total_revenue_at_risk", "negative_ratio", "revenue_at_risk", "PPS", "final_score"]
PRODUCT_DOUBLES = {"total_impact", "avg_rating", "repeat_rate", "avg_customer_ltv", "total_ltv",
                   "avg_order_value", "total_revenue_at_risk", "negative_ratio",
                   "revenue_at_risk", "PPS", "final_score"}
QUAD_COLS = PRODUCT_COLS + ["quadrant", "action", "priority"]


ORACLE: dict[str, str] = {}


def _stable_rounds(text: str) -> str:
    """Rewrite every ``round(x, 6)`` into the engine-stable ``r6(x)`` form."""
    out, i = [], 0
    while True:
        j = text.find("round(", i)
        if j < 0:
            out.append(text[i:])
            return "".join(out)
        if j > 0 and (text[j - 1].isalnum() or text[j - 1] == "_"):
            out.append(text[i:j + 6])
            i = j + 6
            continue
        depth, k, last_comma = 0, j + 6, None
        while k < len(text):
            ch = text[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                last_comma = k
            k += 1
        inner = text[j + 6:k]
        if last_comma is not None and text[last_comma + 1:k].strip() == "6":
            arg = _stable_rounds(text[j + 6:last_comma])
            out.append(text[i:j] + r6(arg))
        else:
            out.append(text[i:j] + "round(" + _stable_rounds(inner) + ")")
        i = k + 1


def register(key: str, deps: list[str], body: str) -> None:
    ORACLE[key] = _stable_rounds(sql(deps, body))


# ---- first batch ------------------------------------------------------------------------
register("run_pipeline", ["products_quad"],
         select_round("products_quad", QUAD_COLS, PRODUCT_DOUBLES))
register("score_reviews", ["scored"], select_round("scored", SCORED_COLS, SCORED_DOUBLES))
register("product_metrics", ["products_m2"],
         select_round("products_m2", PRODUCT_COLS[:12], PRODUCT_DOUBLES))
register("product_scores", ["products"], select_round("products", PRODUCT_COLS, PRODUCT_DOUBLES))
register("classify_quadrants", ["products_quad"],
         select_round("products_quad", QUAD_COLS[:-1], PRODUCT_DOUBLES))


# ---- §2.3 projections ---------------------------------------------------------------------
def mm_cte(name: str, src: str, col: str, variant: str, clip_result: bool = False) -> None:
    cte(f"{name}_st", [src], f"select min({to_double(col)}) mn, max({to_double(col)}) mx from {src}")
    x = to_double(col)
    if variant == "const0":
        e = minmax0(x, "mn", "mx")
    elif variant == "safe":
        e = f"(case when abs(mn - mx) <= (1e-8 + 1e-5 * abs(mx)) then 0.5::double else ({x} - mn) / (mx - mn) end)"
    else:
        e = f"(({x} - mn) / (mx - mn + 1e-9))"
        e = clip01(e) if clip_result else e
    cte(name, [src, f"{name}_st"], f"select s.*, {e} as out_{name} from {src} s cross join {name}_st")


cte("mm_src", ["reviews"], "select helpful_votes, days_since_purchase from reviews")
mm_cte("mm1", "mm_src", "helpful_votes", "const0")
mm_cte("mm2", "mm1", "days_since_purchase", "const0")
register("minmax", ["mm2"], "select round(helpful_votes, 6) helpful_votes, round(days_since_purchase, 6) "
         "days_since_purchase, round(out_mm1, 6) helpful_norm, round(out_mm2, 6) days_norm from mm2")
cte("ms_src", ["norm"], "select helpful_votes, sentiment_score from norm")
mm_cte("ms1", "ms_src", "helpful_votes", "safe")
mm_cte("ms2", "ms1", "sentiment_score", "safe")
register("minmax_safe", ["ms2"], "select round(helpful_votes, 6) helpful_votes, round(sentiment_score, 6) "
         "sentiment_score, round(out_ms1, 6) helpful_norm, round(out_ms2, 6) sentiment_norm from ms2")
cte("me_src", ["reviews"], "select helpful_votes, order_value from reviews")
mm_cte("me1", "me_src", "helpful_votes", "eps")
mm_cte("me2", "me1", "order_value", "eps", clip_result=True)
register("minmax_eps", ["me2"], "select round(helpful_votes, 6) helpful_votes, round(order_value, 6) "
         "order_value, round(out_me1, 6) helpful_norm, round(out_me2, 6) order_norm from me2")

register("log_scale", ["raw"], f"select round(ltv, 6) ltv, round({log1p('ltv')}, 6) ltv_log, "
         f"round(order_value, 6) order_value, round({log1p('order_value')}, 6) order_value_log from raw")
register("recency_plateau", ["reviews"], f"select round(days_since_purchase, 6) days_since_purchase, "
         f"round({recency_plateau('days_since_purchase')}, 6) recency_score from reviews")
register("recency_decay", ["reviews"], f"select round(days_since_purchase, 6) days_since_purchase, "
         f"round({clip01('exp(-days_since_purchase / 30.0)')}, 6) recency from reviews")
register("severity_rating", ["reviews"], f"select round(rating, 6) rating, "
         f"round({clip01('(5.0 - rating) / 4.0')}, 6) severity_rating from reviews")
register("sentiment_to_score", ["reviews"], f"select sentiment, "
         f"round({clip01(sentiment_map('sentiment', K.SENTIMENT_SCORE))}, 6) sentiment_score from reviews")
register("issue_severity", ["reviews"], f"""select round(rating, 6) rating, sentiment,
 round({severity('rating')}, 6) issue_severity,
 round({clip01(f"0.6 * {clip01('(5.0 - rating) / 4.0')} + 0.4 * {sentiment_map('sentiment', K.SENTIMENT_SEVERITY)}")}, 6) issue_severity_sentiment
from reviews""")
register("is_negative", ["raw"], f"select rating, coalesce(cast({to_double('rating')} <= 2 as integer), 0) "
         "as is_negative from raw")
register("encode_flags", ["raw"], f"select is_repeat_customer, verified_purchase, "
         f"{flag('is_repeat_customer')} as repeat, {flag('verified_purchase')} as verified from raw")
register("customer_importance", ["scored"], select_round(
    "scored", ["ltv_norm", "order_norm", "repeat", "verified", "helpful_norm", "recency_score", "CIS"],
    SCORED_DOUBLES))
register("impact_score", ["scored"], select_round(
    "scored", ["CIS", "issue_severity", "rating", "impact_score"], SCORED_DOUBLES))
register("issue_category", ["scored"], "select review_text, issue_category from scored")
register("issue_category_documents", [], f"select doc_id, {category('text')} as issue_category from documents")

# classic path ------------------------------------------------------------------------------
_w = K.CIS_WEIGHTS
_cis = (f"({_w['ltv_norm']} * ltv_norm + {_w['order_norm']} * order_norm + {_w['repeat']} * repeat + "
        f"{_w['verified']} * verified + {_w['helpful_norm']} * helpful_norm + {_w['recency_score']} * recency)")
_sev = "(0.6 * severity_rating + 0.4 * (1.0 - sentiment_score))"


def classic_chain(p: str, src: str) -> None:
    """classic preprocess -> features -> scores -> product metrics, prefix ``p``."""
    cte(f"{p}_prep0", [src], f"""select * exclude (customer_ltv, order_value, helpful_votes, days_since_purchase),
 coalesce({to_double('customer_ltv')}, 0.0) customer_ltv, coalesce({to_double('order_value')}, 0.0) order_value,
 coalesce({to_double('helpful_votes')}, 0.0) helpful_votes,
 coalesce({to_double('days_since_purchase')}, 30.0) days_since_purchase from {src}""")
    cte(f"{p}_prep1", [f"{p}_prep0"], f"select *, {log1p('customer_ltv')} ltv_log, "
        f"{log1p('order_value')} order_value_log from {p}_prep0")
    cte(f"{p}_st", [f"{p}_prep1"], f"""select min(ltv_log) mn_l, max(ltv_log) mx_l, min(order_value_log) mn_o,
 max(order_value_log) mx_o, min(helpful_votes) mn_h, max(helpful_votes) mx_h from {p}_prep1""")
    cte(f"{p}_prep", [f"{p}_prep1", f"{p}_st"], f"""select
 coalesce(p.rating, 0) rating, coalesce(p.customer_ltv, 0) customer_ltv, coalesce(p.order_value, 0) order_value,
 coalesce(p.helpful_votes, 0) helpful_votes, coalesce(p.days_since_purchase, 0) days_since_purchase,
 coalesce(p.ltv_log, 0) ltv_log, coalesce(p.order_value_log, 0) order_value_log,
 coalesce((p.ltv_log - mn_l) / (mx_l - mn_l + 1e-9), 0) ltv_norm,
 coalesce((p.order_value_log - mn_o) / (mx_o - mn_o + 1e-9), 0) order_norm,
 coalesce((p.helpful_votes - mn_h) / (mx_h - mn_h + 1e-9), 0) helpful_norm,
 {flag('p.is_repeat_customer')} repeat, {flag('p.verified_purchase')} verified,
 coalesce(p.product, '0') product, coalesce(p.review_text, '0') review_text,
 coalesce(p.sentiment, '0') sentiment, p.is_repeat_customer, p.verified_purchase, p.review_date
from {p}_prep1 p cross join {p}_st""")
    cte(f"{p}_feat", [f"{p}_prep"], f"""select *,
 coalesce({clip01('(5.0 - rating) / 4.0')}, 0.0) severity_rating,
 coalesce({clip01('exp(-days_since_purchase / 30.0)')}, 0.0) recency,
 coalesce({clip01(sentiment_map('sentiment', K.SENTIMENT_SCORE))}, 0.0) sentiment_score,
 coalesce(cast(rating <= 2 as integer), 0) is_negative from {p}_prep""")
    cte(f"{p}_scored", [f"{p}_feat"], f"""select *, coalesce({clip01(_cis)}, 0.0) "CIS",
 coalesce({clip01(_sev)}, 0.0) severity, coalesce({clip01(_cis + ' * ' + _sev)}, 0.0) impact_score
 from {p}_feat""")
    cte(f"{p}_pm0", [f"{p}_scored"], f"""select product, count(*) total_reviews, sum(impact_score) total_impact,
 avg(severity) avg_severity, avg(is_negative) negative_ratio, {mavg('customer_ltv')} avg_customer_ltv,
 {mavg('order_value')} avg_order_value, avg(repeat) repeat_rate, avg(rating) avg_rating,
 {msum('customer_ltv * is_negative')} total_revenue_at_risk,
 count_if(review_date >= mx - interval 14 days) recent, max(mx) mx
from {p}_scored cross join (select max(review_date) mx from {p}_scored where product is not null) m
where product is not null group by product""")
    cte(f"{p}_pm1", [f"{p}_pm0"], f"""select *, cast(total_reviews as double) order_freq,
 5.0 - avg_rating rating_drop from {p}_pm0""")
    cte(f"{p}_pmst", [f"{p}_pm1"], f"""select min(order_freq) a1, max(order_freq) b1, min(avg_order_value) a2,
 max(avg_order_value) b2, min(repeat_rate) a3, max(repeat_rate) b3, min(rating_drop) a4, max(rating_drop) b4,
 min(negative_ratio) a5, max(negative_ratio) b5 from {p}_pm1""")
    pw = K.PPS_WEIGHTS
    pps = clip01(" + ".join(f"{pw[k]} * {clip01(f'({c} - {a}) / ({b} - {a} + 1e-9)')}" for k, c, a, b in [
        ("freq", "order_freq", "a1", "b1"), ("order", "avg_order_value", "a2", "b2"),
        ("repeat", "repeat_rate", "a3", "b3"), ("rating_drop", "rating_drop", "a4", "b4"),
        ("negative", "negative_ratio", "a5", "b5")]))
    cte(f"{p}_pm2", [f"{p}_pm1", f"{p}_pmst"], f"""select *, {pps} "PPS" from {p}_pm1 cross join {p}_pmst""")
    spike = ("(case when mx is null then null else (recent - cast(total_reviews as double) / 2.14) / "
             "(cast(total_reviews as double) / 4.3 + 1e-9) end)")
    cte(f"{p}_pm3", [f"{p}_pm2"], f"""select *, case when total_impact = 0 then 0.0
 else {log1p('total_impact')} * (1 + "PPS") end as fs0, {spike} as spike_score from {p}_pm2""")
    cte(f"{p}_pm", [f"{p}_pm3"], f"""select product, coalesce(total_reviews, 0) total_reviews,
 coalesce(avg_order_value, 0) avg_order_value, coalesce(avg_rating, 0) avg_rating,
 coalesce(negative_ratio, 0) negative_ratio, coalesce(repeat_rate, 0) repeat_rate,
 coalesce(total_impact, 0) total_impact, coalesce("PPS", 0) "PPS",
 coalesce(total_revenue_at_risk, 0) total_revenue_at_risk,
 coalesce(case when coalesce(spike_score, 0) > 2 then fs0 * 1.5 else fs0 end, 0) final_score
from {p}_pm3""")


classic_chain("cl", "reviews")
register("classic_features", ["cl_feat"], select_round(
    "cl_feat", ["rating", "days_since_purchase", "sentiment", "severity_rating", "recency",
                "sentiment_score", "is_negative"],
    {"rating", "days_since_purchase", "severity_rating", "recency", "sentiment_score"}))
_cl_cols = ["product", "rating", "ltv_norm", "order_norm", "helpful_norm", "repeat", "verified",
            "recency", "severity_rating", "sentiment_score", "CIS", "severity", "impact_score"]
register("classic_scores", ["cl_scored"], select_round(
    "cl_scored", _cl_cols, set(_cl_cols) - {"product", "repeat", "verified"}))

register("risk_category", ["products"], f"""select product, round("PPS", 6) "PPS",
 case when "PPS" >= 0 and "PPS" <= 0.3 then 'Low' when "PPS" > 0.3 and "PPS" <= 0.7 then 'Medium'
      when "PPS" > 0.7 and "PPS" <= 1 then 'High' else 'Low' end risk_category from products""")


def band_sql(x: str, lo: float, hi: float) -> str:
    return f"(case when {x} >= {hi} then 'High' when {x} >= {lo} then 'Medium' when {x} is not null then 'Low' end)"


register("risk_band", ["products"], f"""select product, round("PPS", 6) "PPS",
 {band_sql('"PPS"', 0.4, 0.7)} band_chart, {band_sql('"PPS"', 0.55, 0.75)} band_client from products""")
register("impact_pct", ["products"], """select product, round(total_revenue_at_risk, 6) total_revenue_at_risk,
 least(100, cast(trunc(total_revenue_at_risk / 100000.0::double * 100.0::double) as bigint)) impact from products""")
_split = ", ".join(f"cast(trunc(cast(total_reviews as double) * {s}) as bigint) {k}" for k, s in K.ISSUE_SPLIT)
register("issue_split", ["products"], f"select product, total_reviews, {_split} from products")

cte("rec_mm", ["products_quad"], "select min(final_score) mn, max(final_score) mx from products_quad")
cte("rec0", ["products_quad", "rec_mm"], f"""select p.*,
 {clip01('(final_score - mn) / (case when mx > mn then mx - mn else 1.0 end)')} as nrm
 from products_quad p cross join rec_mm""")
_rsplit = ", ".join(f"cast(trunc(cast(total_reviews as double) * {s}) as bigint) issue_{k}" for k, s in K.ISSUE_SPLIT)
cte("records", ["rec0"], f"""select cast(product as varchar) as name, '2024-06-30' as date,
 round_even(nrm, 2) "finalScore", cast(trunc(total_revenue_at_risk) as bigint) "revenueAtRisk",
 round_even(nrm, 2) "riskProbability", round_even(negative_ratio * 100.0, 1) "negativePct", quadrant,
 cast(total_reviews as bigint) frequency,
 least(100, cast(trunc(total_revenue_at_risk / 100000.0::double * 100.0::double) as bigint)) impact,
 round_even(avg_rating, 1) rating, 'Stable' trend, {band_sql('nrm', 0.4, 0.7)} severity,
 cast(total_reviews as bigint) "totalReviews", {_rsplit}, final_score score from rec0""")
REC_COLS = ["name", "date", "finalScore", "revenueAtRisk", "riskProbability", "negativePct", "quadrant",
            "frequency", "impact", "rating", "trend", "severity", "totalReviews", "issue_delivery",
            "issue_quality", "issue_packaging", "issue_support", "score"]
REC_DOUBLES = {"score", "finalScore", "riskProbability", "negativePct", "rating"}
register("dashboard_records", ["records"], select_round("records", REC_COLS, REC_DOUBLES))
register("severity_band", ["records"], 'select name, round("riskProbability", 6) "riskProbability", severity from records')
register("safe_ratio", ["products"], """select product,
 round(coalesce(cast(negative_count as double) / nullif(cast(total_reviews as double), 0), 0.0), 6) neg_share,
 round(coalesce(total_revenue_at_risk / nullif(cast(negative_count as double), 0), 0.0), 6) revenue_per_negative
from products""")
register("nested_get", [], """select event_id, coalesce(json_extract_string(props, '$.k'), '0') k,
 coalesce(json_extract_string(props, '$.a.b'), 'none') a_b from events""")
register("format_ranking", ["products_quad"], """select product, total_reviews,
 round_even(avg_rating, 2) avg_rating, concat(cast(round_even(negative_ratio * 100.0, 1) as varchar), '%') negative_ratio,
 round_even(final_score, 3) final_score,
 concat('₹', cast(cast(round_even(total_revenue_at_risk, 0) as bigint) as varchar)) total_revenue_at_risk,
 quadrant from products_quad""")


# ---- §2.2 schema, cleaning, quality ------------------------------------------------------
def cnt_if(cond: str) -> str:
    return f"cast(count_if({cond}) as bigint)"


RAW_COLS = ["product_name", "rating", "review_text", "sentiment", "ltv", "order_value",
            "days_since_purchase", "helpful_votes", "is_repeat_customer", "verified_purchase",
            "review_date"]
_dbl = lambda c, d: f"coalesce({to_double(c)}, {d}::double)"
_pstrip = strip("coalesce(cast(product_name as varchar), 'Unknown')")
register("normalize_reviews", ["raw"], f"""select product_name, round({_dbl('rating', 0.0)}, 6) rating,
 cast(review_text as varchar) review_text, sentiment, round(ltv, 6) ltv,
 round({_dbl('order_value', 0.0)}, 6) order_value, round({_dbl('days_since_purchase', 0.0)}, 6) days_since_purchase,
 round({_dbl('helpful_votes', 0.0)}, 6) helpful_votes, {flag('is_repeat_customer')} is_repeat_customer,
 {flag('verified_purchase')} verified_purchase, review_date, 0.0::double sentiment_score,
 round({_dbl('ltv', 0.0)}, 6) customer_ltv, {_pstrip} product
from raw where {_pstrip} <> ''""")
register("normalize_reviews_service", ["raw"], f"""select coalesce(cast(product_name as varchar), 'Unknown Product') product,
 round({_dbl('rating', 3.0)}, 6) rating, coalesce(cast(review_text as varchar), '') review_text, sentiment,
 round(ltv, 6) ltv, round({_dbl('order_value', 0.0)}, 6) order_value,
 round({_dbl('days_since_purchase', 30.0)}, 6) days_since_purchase,
 round({_dbl('helpful_votes', 0.0)}, 6) helpful_votes,
 coalesce(cast(is_repeat_customer as boolean), false) is_repeat_customer,
 coalesce(cast(verified_purchase as boolean), true) verified_purchase, review_date,
 1000.0::double customer_ltv from raw""")
_fstrip = strip("coalesce(cast(product_name as varchar), 'General')")
register("fetch_column_repair", ["raw"], f"""select {_fstrip} product, rating, review_text, sentiment,
 round({_dbl('ltv', 0.0)}, 6) customer_ltv, round(order_value, 6) order_value,
 round(days_since_purchase, 6) days_since_purchase, round(helpful_votes, 6) helpful_votes,
 is_repeat_customer, verified_purchase, review_date from raw where {_fstrip} <> ''""")
_enf = f"""product_name, {_dbl('rating', 3.0)} rating, review_text, sentiment, ltv,
 {_dbl('order_value', 0.0)} order_value,
 cast(trunc({_dbl('days_since_purchase', 30.0)}) as integer) days_since_purchase,
 cast(trunc({_dbl('helpful_votes', 0.0)}) as integer) helpful_votes,
 is_repeat_customer, verified_purchase, review_date, 0.5::double sentiment_score,
 0.0::double customer_ltv, 0 "repeat", 0 verified, 'unknown' detected_issues"""
cte("enf", ["raw"], f"select {_enf} from raw")
ENF_COLS = ["product_name", "rating", "review_text", "sentiment", "ltv", "order_value",
            "days_since_purchase", "helpful_votes", "is_repeat_customer", "verified_purchase",
            "review_date", "sentiment_score", "customer_ltv", "repeat", "verified",
            "detected_issues"]
register("enforce_schema", ["enf"], select_round(
    "enf", ENF_COLS, {"rating", "ltv", "order_value", "sentiment_score", "customer_ltv"}))
cte("rawn", ["raw"], f"select * exclude (rating), {to_double('rating')} rating from raw")
register("fill_missing", ["rawn"], """select product_name, round(coalesce(rating, 3.0), 6) rating, review_text,
 sentiment, round(ltv, 6) ltv, round(coalesce(order_value, 0.0), 6) order_value,
 round(coalesce(days_since_purchase, 30.0), 6) days_since_purchase,
 round(coalesce(helpful_votes, 0.0), 6) helpful_votes, is_repeat_customer, verified_purchase,
 review_date from rawn""")
register("final_null_sweep", ["rawn"], """select coalesce(product_name, '0') product_name,
 round(coalesce(rating, 3.0), 6) rating, coalesce(review_text, '0') review_text,
 coalesce(sentiment, '0') sentiment, round(coalesce(ltv, 0.0), 6) ltv,
 round(coalesce(order_value, 0.0), 6) order_value,
 round(coalesce(days_since_purchase, 30.0), 6) days_since_purchase,
 round(coalesce(helpful_votes, 0.0), 6) helpful_votes, is_repeat_customer, verified_purchase,
 review_date from rawn""")
register("numeric_null_to_zero", ["rawn"], """select product_name, round(coalesce(rating, 0.0), 6) rating,
 review_text, sentiment, round(coalesce(ltv, 0.0), 6) ltv, round(coalesce(order_value, 0.0), 6) order_value,
 round(coalesce(days_since_purchase, 0.0), 6) days_since_purchase,
 round(coalesce(helpful_votes, 0.0), 6) helpful_votes, is_repeat_customer, verified_purchase,
 review_date from rawn""")
register("clip_ranges", ["rawn"], f"""select round({clip('rating * 1.25 - 0.5', 1.0, 5.0)}, 6) rating,
 round({clip('days_since_purchase / 100.0', 0.0, 1.0)}, 6) sentiment_score from rawn""")

_np_parts = " union all ".join(
    f"select '{c}' as \"column\", n_{i} null_count, n_{i} / r * 100.0 null_pct, "
    f"{'true' if c in K.ROBUST_SCHEMA else 'false'} critical from np_c"
    for i, c in enumerate(RAW_COLS))
_np_aggs = ", ".join(
    cnt_if(f"{c} is null" + (f" or isnan({c})" if c in ("ltv", "order_value", "days_since_purchase",
                                                         "helpful_votes") else "")) + f" n_{i}"
    for i, c in enumerate(RAW_COLS))
cte("np_c", ["raw"], f"select count(*) r, {_np_aggs} from raw")
_np_n = " + ".join(f"n_{i}" for i in range(len(RAW_COLS)))
_np_bad = " or ".join(f"n_{i} > 0" for i, c in enumerate(RAW_COLS) if c in K.ROBUST_SCHEMA)
cte("null_rows", ["np_c"], f"""select * from ({_np_parts}) t where null_count > 0
 union all select '(total)', {_np_n}, ({_np_n}) * 100.0 / (r * {len(RAW_COLS)}), {_np_bad} from np_c""")
register("null_profile", ["null_rows"], "select * from null_rows")

_sc_static = [("missing_column", c, "critical", f"Missing column: {c}")
              for c in ["sentiment_score", "customer_ltv", "repeat", "verified", "detected_issues"]]
_sc_static += [("dtype", "rating", "warning", "Column 'rating' is not numeric"),
               ("dtype", "helpful_votes", "warning", "Column 'helpful_votes' is not integer"),
               ("dtype", "days_since_purchase", "warning",
                "Column 'days_since_purchase' is not integer")]
_sc_vals = ", ".join(f"('{a}', '{b}', '{c}', cast(0 as bigint), '{d.replace(chr(39), chr(39) * 2)}')"
                     for a, b, c, d in _sc_static)
_sc_nan = " union all ".join(
    f"""select 'critical_nan', '{c}', 'critical', n, 'Critical column ''{c}'' has ' || cast(n as varchar)
 || ' NaN values (' || format('{{:.1f}}', n / r * 100.0) || '%)' from
 (select {cnt_if(f'{c} is null' + ('' if c == 'rating' else f' or isnan({c})'))} n, count(*) r from raw) where n > 0"""
    for c in ["rating", "order_value", "helpful_votes", "days_since_purchase"])
cte("sanity_rows", ["raw"], f"""select * from (values {_sc_vals}) t("check", "column", severity, n, message)
 union all {_sc_nan}""")
register("sanity_checks", ["sanity_rows"], "select * from sanity_rows")


def safe_mm(x: str, a: str, b: str) -> str:
    return f"(case when abs({a} - {b}) <= (1e-8 + 1e-5 * abs({b})) then 0.5::double else ({x} - {a}) / ({b} - {a}) end)"


cte("rp_l", ["enf"], f"select *, {log1p('customer_ltv')} ltv_log, {log1p('order_value')} order_value_log from enf")
cte("rp_st", ["rp_l"], """select min(ltv_log) a1, max(ltv_log) b1, min(order_value_log) a2, max(order_value_log) b2,
 min(cast(helpful_votes as double)) a3, max(cast(helpful_votes as double)) b3 from rp_l""")
cte("rp", ["rp_l", "rp_st"], f"""select coalesce(product_name, '0') product_name, {clip('rating', 1.0, 5.0)} rating,
 coalesce(review_text, '0') review_text, coalesce(sentiment, '0') sentiment, coalesce(ltv, 0) ltv,
 order_value, days_since_purchase, helpful_votes, is_repeat_customer, verified_purchase, review_date,
 {clip('sentiment_score', 0.0, 1.0)} sentiment_score, customer_ltv, detected_issues,
 coalesce(ltv_log, 0) ltv_log, coalesce(order_value_log, 0) order_value_log,
 coalesce({safe_mm('ltv_log', 'a1', 'b1')}, 0) ltv_norm, coalesce({safe_mm('order_value_log', 'a2', 'b2')}, 0) order_norm,
 coalesce({safe_mm('cast(helpful_votes as double)', 'a3', 'b3')}, 0) helpful_norm,
 {flag('is_repeat_customer')} "repeat", {flag('verified_purchase')} verified
from rp_l cross join rp_st""")
RP_COLS = ENF_COLS + ["ltv_log", "order_value_log", "ltv_norm", "order_norm", "helpful_norm"]
RP_DBL = {"rating", "ltv", "order_value", "sentiment_score", "customer_ltv", "ltv_log",
          "order_value_log", "ltv_norm", "order_norm", "helpful_norm"}
register("robust_preprocess", ["rp"], select_round("rp", RP_COLS, RP_DBL))
register("robust_pipeline", ["rp"], select_round("rp", RP_COLS, RP_DBL))
PREP_COLS = ["product", "sentiment", "sentiment_score", "review_date", "customer_ltv", "order_value",
             "helpful_votes", "days_since_purchase", "review_text", "is_repeat_customer",
             "verified_purchase", "ltv_log", "order_value_log", "rating", "ltv_norm", "order_norm",
             "helpful_norm", "repeat", "verified"]
register("prepare_reviews", ["scored_s1"], select_round(
    "scored_s1", PREP_COLS, {"sentiment_score", "customer_ltv", "order_value", "helpful_votes",
                             "days_since_purchase", "ltv_log", "order_value_log", "rating",
                             "ltv_norm", "order_norm", "helpful_norm"}))
CLP_COLS = ["rating", "customer_ltv", "order_value", "helpful_votes", "days_since_purchase", "ltv_log",
            "order_value_log", "ltv_norm", "order_norm", "helpful_norm", "repeat", "verified", "product",
            "review_text", "sentiment", "is_repeat_customer", "verified_purchase", "review_date"]
register("classic_preprocess", ["cl_prep"], select_round("cl_prep", CLP_COLS, set(CLP_COLS[:10])))
register("ingest_summary", ["norm", "base"], f"""select count(*) total_reviews, count(distinct product) unique_products,
 round(min(customer_ltv), 6) ltv_min, round(max(customer_ltv), 6) ltv_max, round({msum('customer_ltv')}, 6) ltv_sum,
 (select cast(max(ok) + 1 - count(distinct ok) as integer) from base) failed_pages from norm""")

# ---- the gate: constraints on raw reviews -----------------------------------------------------
_gate = [("product_not_blank", "product", "critical", f"{strip('product_name')} <> ''")]
for _c, _x, _lo, _hi in (("rating", "rating", 1.0, 5.0), ("customer_ltv", "ltv", 0.0, None),
                         ("order_value", "order_value", 0.0, None),
                         ("days_since_purchase", "days_since_purchase", 0.0, None),
                         ("helpful_votes", "helpful_votes", 0.0, None)):
    _v = to_double(_x)
    _in = " and ".join([f"{_v} >= {_lo}"] + ([f"{_v} <= {_hi}"] if _hi else []))
    _gate += [(f"{_c}_numeric", _c, "critical", f"{_v} is not null and not isnan({_v})"),
              (f"{_c}_range", _c, "critical", f"{_v} is null or isnan({_v}) or ({_in})")]
_gate.append(("review_text_present", "review_text", "warning", "review_text is not null"))
_names = ", ".join(f"case when not coalesce({h}, false) then '{n}' end" for n, _, s, h in _gate if s == "critical")
cte("gated", ["raw"], f"""select product_name product, rating, review_text, ltv customer_ltv, order_value,
 days_since_purchase, helpful_votes, concat_ws(',', {_names}) violated from raw""")
_gated_cols = """product, rating, review_text, round(customer_ltv, 6) customer_ltv, round(order_value, 6) order_value,
 round(days_since_purchase, 6) days_since_purchase, round(helpful_votes, 6) helpful_votes"""
register("accepted_reviews", ["gated"], f"select {_gated_cols} from gated where violated = ''")
register("quarantined_reviews", ["gated"], f"select {_gated_cols}, violated from gated where violated <> ''")
register("gate_report", ["raw"], " union all ".join(
    f"""select '{n}' "constraint", '{c}' "column", '{s}' severity,
 cast(count_if(not coalesce({h}, false)) as bigint) violations, count(*) "rows" from raw""" for n, c, s, h in _gate))
register("quality_overview", ["scored"], f"""select count(*) total_reviews, count(distinct product) unique_products,
 round(coalesce({msum('customer_ltv')}, 0.0), 6) total_ltv from scored""")

# ---- §2.4 filters -----------------------------------------------------------------------
_pick = "('red plate Brand#8', 'hot rod Brand#16', 'blue widget Brand#15')"
register("filter_products", ["scored"], f"""select product, round(rating, 6) rating,
 round(impact_score, 6) impact_score from scored where product in {_pick}""")
register("filter_dates", ["scored"], """select product, review_date, round(rating, 6) rating from scored
 where review_date >= timestamp '1996-01-01 00:00:00' and review_date <= timestamp '1996-12-31 23:59:59.999999'""")
register("filter_severity", ["scored"], """select product, round(issue_severity, 6) issue_severity
 from scored where issue_severity >= 0.5""")
register("apply_filters", ["scored"], """select product, review_date, round(issue_severity, 6) issue_severity,
 round(impact_score, 6) impact_score from scored
 where review_date >= timestamp '1995-06-01 00:00:00' and review_date <= timestamp '1997-06-30 23:59:59.999999'
 and issue_severity >= 0.45""")
register("filter_records", ["records"], select_round(
    "records", REC_COLS, REC_DOUBLES,
    'date >= \'2024-01-01\' and date <= \'2024-12-31\' and "riskProbability" >= 0.5'))
register("search_products", ["records"], """select name, round("finalScore", 6) "finalScore" from records
 where contains(lower(name), 'brand#1')""")
register("product_lookup", ["products_quad"], "select * from (" + select_round(
    "products_quad", QUAD_COLS, PRODUCT_DOUBLES,
    "lower(product) = 'red plate brand#8'") + ") order by final_score desc, product limit 1")
register("risky_reviews", ["scored"], """select product, round(rating, 6) rating,
 round(customer_ltv, 6) customer_ltv from scored where rating <= 2.5""")
register("complaint_reviews", ["scored"], """select product, round(rating, 6) rating, issue_category
 from scored where rating <= 3""")
register("drop_blank_products", ["raw"], f"""select product_name product, rating from raw
 where coalesce({strip('product_name')} <> '', true)""")

# ---- §2.5 joins / §2.7 windows ------------------------------------------------------------
register("reviews_of_products", ["scored", "products_quad"], """select product, round(rating, 6) rating,
 round(impact_score, 6) impact_score from scored
 where product in (select product from products_quad where quadrant = 'The Fire-Fight')""")
register("review_count_window", ["scored"], """select product, round(impact_score, 6) impact_score,
 count(impact_score) over (partition by product) review_count from scored""")
register("top3_flag", ["products_quad"], """select product, round(total_revenue_at_risk, 6) total_revenue_at_risk,
 product in (select product from products_quad order by total_revenue_at_risk desc, product limit 3) is_top3
 from products_quad""")

# ---- §2.6 aggregations ------------------------------------------------------------------
register("revenue_at_risk", ["scored"], f"""select
 round(coalesce({msum('case when rating <= 2.5 then customer_ltv end')}, 0.0), 6) total_rev_risk,
 {cnt_if('rating <= 2.5')} num_risky_reviews,
 round(coalesce({mavg('case when rating <= 2.5 then customer_ltv end')}, 0.0), 6) avg_ltv_per_risk from scored""")
register("summary_stats", ["scored", "products_quad"], f"""select * from (select count(*) total_reviews,
 round(coalesce({msum('case when rating <= 2.5 then customer_ltv end')}, 0.0), 6) total_revenue_at_risk,
 {cnt_if('rating <= 2.5')} risky_reviews,
 round(coalesce({mavg('case when rating <= 2.5 then customer_ltv end')}, 0.0), 6) avg_ltv_per_risky_review,
 round(avg(rating), 6) avg_rating,
 round(coalesce(cast(sum("repeat") as double) / nullif(cast(count(*) as double), 0), 0.0) * 100.0, 6) repeat_customer_pct,
 round(coalesce(cast(sum(verified) as double) / nullif(cast(count(*) as double), 0), 0.0) * 100.0, 6) verified_purchase_pct
 from scored) a cross join (select count(*) total_products, round(avg(final_score), 6) avg_final_score,
 round(max(final_score), 6) max_final_score, {cnt_if("quadrant = 'The Fire-Fight'")} critical_products,
 {cnt_if("quadrant = 'The VIP Nudge'")} vip_products from products_quad) b""")
register("kpis", ["scored", "products_quad"], f"""select
 round((select coalesce({msum('total_revenue_at_risk')}, 0.0) from products_quad), 6) total_revenue_at_risk,
 count(*) total_reviews,
 round(coalesce(cast(sum(is_negative) as double) / nullif(cast(count(*) as double), 0), 0.0) * 100.0, 6) negative_pct,
 coalesce((select product from products_quad order by final_score desc, product limit 1), 'N/A') top_product,
 cast(0 as bigint) high_risk_count from scored""")
register("kpis_weighted", ["records"], f"""select cast(coalesce(sum("revenueAtRisk"), 0) as bigint) total_revenue,
 cast(coalesce(sum("totalReviews"), 0) as bigint) total_reviews,
 round(case when sum("totalReviews") > 0 then sum("negativePct" / 100.0 * "totalReviews") / sum("totalReviews") else 0.0 end * 100.0, 6) negative_pct,
 round(coalesce(avg("riskProbability"), 0.0), 6) avg_probability, {cnt_if("severity = 'High'")} high_risk_count,
 count(*) products_in_view,
 case when (case when sum("totalReviews") > 0 then sum("negativePct" / 100.0 * "totalReviews") / sum("totalReviews") else 0.0 end) > 0.22
  then 'Above baseline' else 'Within baseline' end negative_note from records""")
_ib = ", ".join(f"{cnt_if(chr(39).join(['issue_category = ', c, '']))} \"{c}\"" for c in K.ISSUE_CATEGORIES)
_ib_tot = " + ".join(cnt_if(f"issue_category = '{c}'") for c in K.ISSUE_CATEGORIES)
register("issue_breakdown", ["scored"], f"""select product, {_ib}, {_ib_tot} total from scored
 where rating <= 3 group by product""")
register("risk_distribution", ["records"], f"""select band, products, round(products / sum(products) over (), 6) share
 from (select {band_sql('"riskProbability"', 0.4, 0.7)} band, count(*) products from records
       where "riskProbability" is not null group by 1)""")
register("severity_distribution", ["records"], """select severity, products,
 round(products / sum(products) over (), 6) share from (select severity, count(*) products from records group by 1)""")
_dp = strip("coalesce(cast(product_name as varchar), 'Unknown')")
register("distinct_products", ["raw"], f"""select distinct {_dp} product from raw
 where {_dp} <> '' and {_dp} <> 'Unknown'""")
register("date_bounds", ["scored"], "select min(review_date) min_date, max(review_date) max_date from scored")
register("date_bounds_events", [], "select min(ts) min_date, max(ts) max_date from events")
register("quantile_thresholds", ["products_quad"], """select round(quantile_cont(total_revenue_at_risk, 0.75), 6) p75_revenue,
 round(quantile_cont(total_impact, 0.75), 6) p75_impact, round(quantile_cont(negative_ratio, 0.75), 6) p75_negative,
 round(quantile_cont(final_score, 0.75), 6) p75_score, round(quantile_cont(avg_rating, 0.25), 6) p25_rating
 from products_quad""")
register("issue_totals", ["records"], " union all ".join(
    f"select '{k}' issue, cast(sum(issue_{k}) as bigint) total from records" for k, _ in K.ISSUE_SPLIT))
cte("spike_reviews", [], __import__("revlens.sources.tables", fromlist=["x"]).SPIKE_REVIEWS_SQL)
register("spike_stats", ["spike_reviews"], """select product, recent_14, total_reviews_30,
 round((recent_14 - total_reviews_30 / 2.14) / (total_reviews_30 / 4.3 + 1e-9), 6) spike_score from (
 select product, cast(count_if(review_date >= mx - interval 14 days) as bigint) recent_14,
  count(*) total_reviews_30 from spike_reviews cross join (select max(review_date) mx from spike_reviews)
 group by product)""")
register("score_validation", ["cl_scored"], """select round(high_ltv_avg_impact, 6) high_ltv_avg_impact,
 round(low_ltv_avg_impact, 6) low_ltv_avg_impact, cis_out_of_range, severity_out_of_range, impact_out_of_range,
 null_scores, round(ratio, 6) high_ltv_vs_low_ltv,
 coalesce(ratio > 1.0, true) and cis_out_of_range = 0 and severity_out_of_range = 0 and impact_out_of_range = 0
  and null_scores = 0 passed from (
 select *, case when low_ltv_avg_impact > 0 then high_ltv_avg_impact / low_ltv_avg_impact end ratio from (
 select avg(case when rating <= 2 and customer_ltv >= med then impact_score end) high_ltv_avg_impact,
  avg(case when rating <= 2 and customer_ltv < med then impact_score end) low_ltv_avg_impact,
  cast(count_if(not ("CIS" between 0 and 1)) as bigint) cis_out_of_range,
  cast(count_if(not (severity between 0 and 1)) as bigint) severity_out_of_range,
  cast(count_if(not (impact_score between 0 and 1)) as bigint) impact_out_of_range,
  cast(count_if("CIS" is null) + count_if(severity is null) + count_if(impact_score is null) as bigint) null_scores
 from cl_scored cross join (select quantile_cont(customer_ltv, 0.5) med from cl_scored)))""")

# ---- §2.8 sorts / top-k -------------------------------------------------------------------
register("rank_products", ["products_quad"], "select product, round(final_score, 6) final_score from products_quad")
register("top_revenue", ["products_quad"], """select product, round(total_revenue_at_risk, 6) total_revenue_at_risk
 from products_quad order by total_revenue_at_risk desc, product limit 5""")
register("top_for_insight", ["products_quad"], """select product, round(final_score, 6) final_score
 from products_quad order by final_score desc, product limit 5""")
register("top_risk_cards", ["records"], """select name, round("riskProbability", 6) "riskProbability",
 "revenueAtRisk", frequency from records order by "riskProbability" desc, score desc, name limit 5""")
register("top_product", ["products_quad"], """select coalesce((select product from products_quad
 order by final_score desc, product limit 1), 'N/A') top_product""")
register("sort_records", ["records"], """select name, "revenueAtRisk", round("finalScore", 6) "finalScore" from records""")
register("revenue_ranking", ["products_quad"], """select product, round(total_revenue_at_risk, 6) total_revenue_at_risk
 from products_quad""")
register("top_issue", ["records"], """select name, case greatest(issue_delivery, issue_quality, issue_packaging, issue_support)
 when issue_delivery then 'delivery' when issue_quality then 'quality' when issue_packaging then 'packaging'
 else 'support' end top_issue from records""")
register("top_two_issues", ["records"], " select * from (" + " union all ".join(
    f"select '{k}' issue, cast(sum(issue_{k}) as bigint) total from records" for k, _ in K.ISSUE_SPLIT)
    + ") order by total desc, issue limit 2")
register("preview", ["scored"], """select product, round(rating, 6) rating, review_text,
 round(issue_severity, 6) issue_severity, is_negative, round(impact_score, 6) impact_score from scored
 order by impact_score desc, product asc nulls first, rating asc nulls first, review_text asc nulls first,
 issue_severity asc nulls first, is_negative asc nulls first limit 20""")

# ---- §2.9 product-level decisions --------------------------------------------------------
register("product_priority", ["products_pps"], 'select product, round("PPS", 6) "PPS" from products_pps')
register("final_score", ["products"], """select product, round(total_impact, 6) total_impact,
 round("PPS", 6) "PPS", round(final_score, 6) final_score from products""")
CPM_COLS = ["product", "total_reviews", "avg_order_value", "avg_rating", "negative_ratio", "repeat_rate",
            "total_impact", "PPS", "total_revenue_at_risk", "final_score"]
CPM_DBL = set(CPM_COLS) - {"product", "total_reviews"}
register("classic_product_metrics", ["cl_pm"], select_round("cl_pm", CPM_COLS, CPM_DBL))
register("zero_impact_gate", ["cl_pm"], select_round(
    "cl_pm", ["product", "total_impact", "final_score"], CPM_DBL, "total_impact = 0"))
classic_chain("cs", "spike_reviews")
register("spike_boost", ["cs_pm"], select_round(
    "cs_pm", ["product", "total_reviews", "total_impact", "PPS", "final_score"], CPM_DBL))
register("quadrant_priority", ["products_quad"], "select product, quadrant, priority from products_quad")
cte("md_t", ["cl_pm"], """select quantile_cont(total_revenue_at_risk, 0.75) t_rev, quantile_cont(total_impact, 0.75) t_imp,
 quantile_cont(negative_ratio, 0.75) t_neg, quantile_cont(avg_rating, 0.25) t_rating,
 quantile_cont(final_score, 0.75) t_score from cl_pm""")
cte("md", ["cl_pm", "md_t"], """select p.*, case
 when total_revenue_at_risk >= t_rev and negative_ratio >= t_neg then 'Immediate Fix Required'
 when total_impact >= t_imp then 'Investigate Root Cause' when avg_rating <= t_rating then 'Improve Product Experience'
 when negative_ratio > 0.3 then 'Respond to Customers' else 'Monitor' end action,
 case when final_score >= t_score then 'High' when final_score >= t_score * 0.5 then 'Medium' else 'Low' end priority
 from cl_pm p cross join md_t""")
register("make_decisions", ["md"], select_round("md", CPM_COLS + ["action", "priority"], CPM_DBL))
register("quadrant_chart_data", ["products_quad"], """select product, round(negative_ratio, 6) negative_ratio,
 round(total_revenue_at_risk, 6) total_revenue_at_risk, round(final_score, 6) final_score, quadrant,
 round(quantile_cont(negative_ratio, 0.75) over (), 6) x_threshold,
 round(quantile_cont(total_revenue_at_risk, 0.75) over (), 6) y_threshold from products_quad""")


# ---- §2.10 ML features / labels ------------------------------------------------------------
cte("mlf", ["products_quad"], f"""select product,
 case when total_reviews > 0 then cast(round_even(negative_ratio * total_reviews, 0) as integer) else 0 end negative_reviews,
 {clip01('negative_ratio')} avg_severity, negative_ratio, total_impact, cast(total_reviews as double) total_reviews,
 repeat_rate, avg_order_value, {clip('5.0 - avg_rating', 0.0, 5.0)} rating_drop, 0.0::double recency_score,
 case when total_reviews > 0 then total_impact / total_reviews else 0.0 end impact_per_review,
 final_score from products_quad""")
cte("mlf2", ["mlf"], """select *, avg_severity * impact_per_review severity_impact,
 total_reviews * (1 + recency_score) review_velocity from mlf""")
ML_COLS = ["product", "negative_reviews"] + list(K.ML_FEATURES)
register("ml_features", ["mlf2"], select_round("mlf2", ML_COLS, set(K.ML_FEATURES)))
register("risk_labels", ["mlf2"], """select product, round(final_score, 6) final_score,
 round(quantile_cont(final_score, 0.75) over (), 6) risk_threshold,
 cast(final_score > quantile_cont(final_score, 0.75) over () as integer) high_risk from mlf2""")

# The fitted model: the same Newton steps, a row of a recursive table each.
def newton_cte(name: str, src: str, features: list[str], steps: int, cap: float, tolerance: float) -> None:
    """``name``_w: the weights (intercept last) of the logistic regression over CTE ``src``;
    ``name``_z: its rows with standardised features x and label y."""
    k = len(features)
    cte(f"{name}_s", [src], "select quantile_cont(final_score, 0.75) thr, " + ", ".join(
        f"avg({f}) m{i}, case when stddev_pop({f}) = 0 then 1.0::double else stddev_pop({f}) end s{i}"
        for i, f in enumerate(features)) + f" from {src}")
    z = ", ".join([*(f"(p.{f} - m{i}) / s{i}" for i, f in enumerate(features)), "1.0::double"])
    cte(f"{name}_z", [src, f"{name}_s"], f"""select p.*, [{z}] x, cast(p.final_score > thr as integer) y
 from {src} p cross join {name}_s""")
    sums = ", ".join([*(f"sum((p - y) * x[{i + 1}]) g{i}" for i in range(k + 1)),
                      *(f"sum(p * (1 - p) * x[{i + 1}] * x[{j + 1}]) h{i}_{j}"
                        for i in range(k + 1) for j in range(i, k + 1))])
    # the system to be solved: Hessian and penalty, then the gradient
    rows = ", ".join("[" + ", ".join(
        [f"h{min(i, j)}_{max(i, j)}" + (" + 1" if i == j < k else "") for j in range(k + 1)]
        + [f"g{i}" + (f" + w[{i + 1}]" if i < k else "")]) + "]" for i in range(k + 1))
    cte(f"{name}_it", [f"{name}_z"], f"""with recursive it as (
 select 0 step, list_transform(range({k + 1}), lambda i: 0.0::double) w, 1e9::double moved
 union all
 select step + 1, list_transform(w, lambda v, i: v - f * d[i]), f * top from (
  select *, least(1.0, {cap} / greatest(top, 1e-300)) f from (
   select *, list_max(list_transform(d, lambda v: abs(v))) top from (
    select step, w, list_transform(list_reduce(
      list_prepend([{rows}], list_transform(range({k + 1}), lambda c: [[c::double]])),
      lambda m, c: list_transform(m, lambda r, i: case when i = c[1][1] + 1
        then list_transform(r, lambda v: v / r[cast(c[1][1] as integer) + 1])
        else list_transform(r, lambda v, j: v - r[cast(c[1][1] as integer) + 1]
          * m[cast(c[1][1] as integer) + 1][j]
          / m[cast(c[1][1] as integer) + 1][cast(c[1][1] as integer) + 1]) end)), lambda r: r[{k + 2}]) d
    from (select any_value(step) step, any_value(w) w, {sums} from (
      select step, w, x, y, 1 / (1 + exp(-list_dot_product(w, x))) p from it cross join {name}_z
      where step < {steps} and moved > {tolerance!r}) having count(*) > 0)))))
select * from it""")
    cte(f"{name}_w", [f"{name}_it"], f"select w, step from {name}_it order by step desc limit 1")


newton_cte("ml", "mlf2", list(K.ML_FEATURES), RK.MAX_STEPS, RK.STEP_CAP, RK.TOLERANCE)
_category = ("case when risk_probability >= 0 and risk_probability <= 0.3 then 'Low' "
             "when risk_probability > 0.3 and risk_probability <= 0.7 then 'Medium' "
             "when risk_probability > 0.7 and risk_probability <= 1 then 'High' else 'Low' end")
cte("ml_p", ["ml_z", "ml_w"], f"""select *, cast(risk_probability > 0.5 as integer) high_risk_predicted,
 {_category} risk_category from (select z.*, 1 / (1 + exp(-list_dot_product(w, x))) risk_probability
 from ml_z z cross join ml_w)""")
cte("ml_products", ["products_quad", "ml_p"], """select q.*, risk_probability, risk_category, high_risk_predicted
 from products_quad q join ml_p p on p.product = q.product""")
_model = " union all ".join(
    [f"select '{f}' feature, m{i} mean, s{i} scale, w[{i + 1}] coefficient from ml_s cross join ml_w"
     for i, f in enumerate(K.ML_FEATURES)]
    + [f"select '(intercept)', 0.0, 1.0, w[{len(K.ML_FEATURES) + 1}] from ml_w"])
cte("ml_model", ["ml_s", "ml_w"], _model)
register("train_risk_model", ["ml_model"], """select feature, round(mean, 6) mean, round(scale, 6) scale,
 round(coefficient, 6) coefficient from ml_model""")
register("feature_importance", ["ml_model"], """select feature, round(coefficient, 6) coefficient,
 round(abs(coefficient), 6) abs_coefficient from ml_model where feature <> '(intercept)'""")
register("training_stats", ["ml_p", "ml_s"], f"""select
 round(avg(cast(high_risk_predicted = y as double)), 6) training_accuracy, cast(sum(y) as bigint) high_risk_count,
 cast(count(*) - sum(y) as bigint) low_risk_count, round(any_value(thr), 6) model_threshold,
 0.75::double quantile_used, {len(K.ML_FEATURES)}::integer num_features, count(*) samples_trained
 from ml_p cross join ml_s""")
register("predict_risk", ["ml_p"], """select product, round(risk_probability, 6) risk_probability,
 high_risk_predicted, risk_category from ml_p""")
ML_PRODUCT_COLS = QUAD_COLS + ["risk_probability", "risk_category", "high_risk_predicted"]
for _name in ("apply_ml_predictions", "join_predictions"):
    register(_name, ["ml_products"], select_round(
        "ml_products", ML_PRODUCT_COLS, PRODUCT_DOUBLES | {"risk_probability"}))

# ---- §2.11 insights ----------------------------------------------------------------------------
_summary = ("product || ' is in ' || quadrant || ' with priority ' || priority || ' and final score ' || "
            "format('{:.3f}', round_even(final_score, 4)) || '.'")
_driver = ("'Revenue at risk is INR ' || format('{:,.0f}', round_even(total_revenue_at_risk, 2)) || "
           "', negative ratio is ' || format('{:.1f}', round_even(negative_ratio, 4) * 100.0) || "
           "'%, and ML risk probability is ' || format('{:.1f}', 0.0::double) || '%.'")
_rec = "'Recommended action remains: ' || action || '.'"
cte("rule", ["products_quad"], f"""select *, {_summary} llm_summary, {_driver} llm_driver,
 {_rec} llm_recommendation, 'rule_based' llm_source from products_quad""")
register("rule_insight", ["rule"], "select product, llm_summary, llm_driver, llm_recommendation, llm_source from rule")
cte("top5", ["rule"], "select * from rule order by final_score desc, product limit 5")
cte("enrich", ["products_quad", "top5"], """select p.product, p.final_score, coalesce(t.llm_summary, '') llm_summary,
 coalesce(t.llm_driver, '') llm_driver, coalesce(t.llm_recommendation, '') llm_recommendation,
 coalesce(t.llm_source, '') llm_source from products_quad p left join top5 t on p.product = t.product""")
register("enrich_products", ["enrich"], "select product, llm_summary, llm_driver, llm_recommendation, llm_source from enrich")
register("parse_insight_reply", ["products_quad"], """select product,
 case when total_reviews % 2 = 0 then 'Watch ' || product else '' end llm_summary,
 case when total_reviews % 2 = 0 then quadrant else '' end llm_driver,
 case when total_reviews % 2 = 0 then action else '' end llm_recommendation from products_quad""")
register("merge_insights", ["rule"], """select product,
 case when total_reviews % 2 = 0 then 'Watch ' || product else llm_summary end llm_summary,
 case when total_reviews % 2 = 0 then quadrant else llm_driver end llm_driver,
 case when total_reviews % 2 = 0 then action else llm_recommendation end llm_recommendation,
 case when total_reviews % 2 = 0 then 'model' else llm_source end llm_source from rule""")
register("insight_view", ["enrich"], """select product, llm_source, llm_summary, llm_driver, llm_recommendation
 from enrich where llm_summary <> '' order by final_score desc, product limit 5""")
cte("cards", ["records"], """select name, severity, frequency, case greatest(issue_delivery, issue_quality, issue_packaging, issue_support)
 when issue_delivery then 'delivery' when issue_quality then 'quality' when issue_packaging then 'packaging'
 else 'support' end top_issue from records""")
register("product_card_text", ["cards"], """select name, severity, frequency, top_issue, case
 when severity = 'High' then 'High priority: ' || cast(frequency as varchar) || ' issues detected. Top concern: ' || top_issue || '. Immediate action recommended to prevent revenue loss.'
 when severity = 'Medium' then 'Medium risk detected with ' || cast(frequency as varchar) || ' reported issues. Primary issue: ' || top_issue || '. Monitor closely for escalation.'
 else 'Low risk profile with ' || cast(frequency as varchar) || ' issues. Routine follow-up recommended to maintain stability.' end card_text
 from cards""")
_it = " union all ".join(f"select '{k}' issue, sum(issue_{k}) total from records" for k, _ in K.ISSUE_SPLIT)
cte("its", ["records"], f"select issue, total, row_number() over (order by total desc, issue) rk from ({_it})")
cte("pf", ["records", "its"], """select
 (select name from records order by "revenueAtRisk" desc, score desc, name limit 1) top_revenue_product,
 (select max("revenueAtRisk") from records) top_revenue,
 (select "riskProbability" from records order by "revenueAtRisk" desc, score desc, name limit 1) top_revenue_risk,
 (select name from records order by impact desc, score desc, name limit 1) top_impact_product,
 (select issue from its where rk = 1) top_issue, (select issue from its where rk = 2) secondary_issue""")
register("portfolio_summary", ["pf"], """select top_revenue_product, top_impact_product, top_issue, secondary_issue,
 top_revenue_product || ' carries the largest revenue exposure at $' || format('{:,.0f}', cast(top_revenue as double))
 || ', driven by elevated ' || top_issue || ' complaints and a risk probability of ' || format('{:.2f}', top_revenue_risk)
 || '. ' || top_impact_product || ' remains the highest impact item in the current view, indicating a need for '
 || 'direct product and support coordination. Across the filtered set, ' || upper(substr(top_issue, 1, 1))
 || lower(substr(top_issue, 2)) || ' and ' || secondary_issue || ' account for most issue volume, while lower-risk '
 || 'products remain commercially contained. Prioritize immediate remediation on Fire Fight items first, then '
 || 'address VIP Nudge products where issue frequency is lower but business impact remains material.' summary
 from pf""")

register("portfolio_prompt", ["records", "its"], """select 'product' kind, name,
 concat('{"name":"', name, '","revenueAtRisk":', "revenueAtRisk", ',"riskProbability":', "riskProbability",
  ',"quadrant":"', quadrant, '","severity":"', severity, '"}') prompt from records
 union all select 'issueTotals', null, concat('{', (select string_agg(concat('"', issue, '":', cast(total as bigint)), ','
  order by case issue when 'delivery' then 1 when 'quality' then 2 when 'packaging' then 3 else 4 end) from its), '}')""")

# ---- consumers of predictions, over probabilities derived from the tables (PPS) ---------------
_cat = """case when "PPS" >= 0 and "PPS" <= 0.3 then 'Low' when "PPS" > 0.3 and "PPS" <= 0.7 then 'Medium'
 when "PPS" > 0.7 and "PPS" <= 1 then 'High' else 'Low' end"""
cte("pred", ["products_quad"], f"""select *, "PPS" risk_probability, {_cat} risk_category,
 cast("PPS" > 0.5 as integer) high_risk_predicted from products_quad""")
register("join_predictions_given", ["pred"], select_round(
    "pred", QUAD_COLS + ["risk_probability", "risk_category", "high_risk_predicted"],
    PRODUCT_DOUBLES | {"risk_probability"}))


def kpis_enhanced_sql(reviews: str, products: str) -> str:
    return f"""select
 round((select coalesce({msum('total_revenue_at_risk')}, 0.0) from {products}), 6) total_revenue_at_risk, count(*) total_reviews,
 round(coalesce(cast(sum(is_negative) as double) / nullif(cast(count(*) as double), 0), 0.0) * 100.0, 6) negative_pct,
 coalesce((select product from {products} order by final_score desc, product limit 1), 'N/A') top_product,
 (select {cnt_if("risk_category = 'High'")} from {products}) high_risk_count,
 (select {cnt_if("risk_category = 'Medium'")} from {products}) medium_risk_count,
 (select round(coalesce(avg(risk_probability), 0.0), 6) from {products}) avg_risk_probability from {reviews}"""


def prediction_consumers(src: str, suffix: str, hidden: float) -> None:
    """What reads predictions, over the products of CTE ``src``."""
    register(f"risk_summary{suffix}", [src], f"""select {cnt_if("risk_category = 'High'")} high_risk_count,
 {cnt_if("risk_category = 'Medium'")} medium_risk_count, {cnt_if("risk_category = 'Low'")} low_risk_count,
 round(avg(risk_probability), 6) avg_risk_probability,
 (select product from {src} order by risk_probability desc, product limit 1) max_risk_product,
 round(max(risk_probability), 6) max_risk_probability from {src}""")
    register(f"ml_insight_kpis{suffix}", [src], f"""select
 {cnt_if("risk_probability > 0.7 and quadrant <> 'The Fire-Fight'")} hidden_risks,
 round(avg(risk_probability), 6) portfolio_risk,
 round(coalesce({msum('case when risk_probability > 0.7 then total_revenue_at_risk end')}, 0.0), 6) high_risk_revenue from {src}""")
    register(f"hidden_risks{suffix}", [src], f"""select product, quadrant, round(risk_probability, 6) risk_probability
 from {src} where risk_probability > {hidden} and quadrant <> 'The Fire-Fight'""")
    register(f"filter_risk{suffix}", [src], f"""select product, round(risk_probability, 6) risk_probability
 from {src} where risk_probability >= 0.5""")
    register(f"rating_vs_risk_data{suffix}", [src], f"""select product, round(avg_rating, 6) avg_rating,
 round(risk_probability, 6) risk_probability, {band_sql('risk_probability', 0.4, 0.7)} band,
 round_even(risk_probability * 100.0, 1) risk_pct from {src}""")
    register(f"kpis_enhanced{suffix}", ["scored", src], kpis_enhanced_sql("scored", src))


prediction_consumers("pred", "_given", 0.5)
prediction_consumers("ml_products", "", 0.7)


def again(name: str, where: str) -> None:
    """Products of the reviews that a filter leaves, with the predictions made on all reviews."""
    cte(f"{name}_r", ["scored"], f"select * from scored where {where}")
    product_chain(f"{name}_p", f"{name}_r")
    cte(name, [f"{name}_p_quad", "ml_p"], f"""select q.*, coalesce(p.risk_probability, 0.0) risk_probability,
 coalesce(p.risk_category, 'Low') risk_category, coalesce(p.high_risk_predicted, 0) high_risk_predicted
 from {name}_p_quad q left join ml_p p on p.product = q.product""")


_days = "review_date >= timestamp '1995-06-01' and review_date < timestamp '1999-01-01'"
again("later", _days)
register("restore_predictions", ["later"], select_round(
    "later", [c for c in ML_PRODUCT_COLS if c != "priority"], PRODUCT_DOUBLES | {"risk_probability"}))
again("board", f"{_days} and issue_severity >= 0.4")
cte("board_kept", ["board"], "select * from board where risk_probability >= 0.3")
cte("board_reviews", ["board_r", "board_kept"], "select * from board_r where product in (select product from board_kept)")
register("filtered_dashboard", ["board_reviews", "board_kept"], kpis_enhanced_sql("board_reviews", "board_kept"))

# ---- §2.12 pipelines -------------------------------------------------------------------------
cte("svc", ["raw"], f"""select coalesce(cast(product_name as varchar), 'Unknown Product') product,
 {_dbl('rating', 3.0)} rating, coalesce(cast(review_text as varchar), '') review_text, sentiment, ltv,
 {_dbl('order_value', 0.0)} order_value, {_dbl('days_since_purchase', 30.0)} days_since_purchase,
 {_dbl('helpful_votes', 0.0)} helpful_votes, coalesce(cast(is_repeat_customer as boolean), false) is_repeat_customer,
 coalesce(cast(verified_purchase as boolean), true) verified_purchase, review_date, 1000.0::double customer_ltv
 from raw""")
scored_chain("svc_scored", "svc", ["product", "sentiment", "ltv", "review_date"])
scored_final("svc_scored", ["ltv"], ["product", "sentiment", "review_date", "is_repeat_customer",
                                     "verified_purchase"])
product_chain("svc_products", "svc_scored")
register("run_service", ["svc_products_quad"], select_round("svc_products_quad", QUAD_COLS[:-1], PRODUCT_DOUBLES))
register("run_classic", ["md"], select_round("md", CPM_COLS + ["action", "priority"], CPM_DBL))

# ---- §2.1 sources ------------------------------------------------------------------------------
register("page_gap_report", ["base"], """select cast(range as integer) page
 from range(1, (select max(ok) + 2 from base)) where range not in (select distinct ok + 1 from base)""")


# ---- streaming ---------------------------------------------------------------------------------
register("stream_revenue_at_risk", ["reviews"], f"""select product, count(*) total_reviews,
 cast(count_if(rating <= 2.5) as bigint) negative_count,
 round(coalesce({msum('case when rating <= 2.5 then customer_ltv end')}, 0.0), 6) total_revenue_at_risk
 from reviews group by product""")
from revlens.sources.tables import PRODUCT_SQL, RATING_SQL  # noqa: E402

register("stream_land_pages", ["base"], f"""select cast(ok + 1 as integer) page, {PRODUCT_SQL} product,
 round({RATING_SQL}, 6) rating, round(case when ab > 0 then ab else 0.0 end, 6) customer_ltv from base""")


# ---- round trips through files, guards -------------------------------------------------------
_norm_stable = ("product, round(rating, 6) rating, review_text, sentiment, round(customer_ltv, 6) customer_ltv, "
                "round(order_value, 6) order_value, round(days_since_purchase, 6) days_since_purchase, "
                "round(helpful_votes, 6) helpful_votes, is_repeat_customer, verified_purchase, "
                "round(sentiment_score, 6) sentiment_score")
register("read_reviews_csv", ["norm"], f"select {_norm_stable} from norm")
register("read_reviews_json", ["norm"], f"select {_norm_stable} from norm")
register("load_reviews", ["norm"], f"select {_norm_stable} from norm")
register("read_review_pages", ["base"], f"""select cast(ok + 1 as integer) page, {PRODUCT_SQL} product,
 round({RATING_SQL}, 6) rating, {__import__('revlens.sources.tables', fromlist=['x'])._text_sql()} review_text,
 round(case when ab > 0 then ab else 0.0 end, 6) customer_ltv, round(tp, 6) order_value,
 round(q, 6) helpful_votes from base""")
register("assert_columns", ["reviews"], """select 'columns' "check", input, ok, message, n from (select count(*) n from reviews)
 cross join (values ('present', true, ''), ('absent', false, 'reviews: missing columns [''no_such'']')) t(input, ok, message)""")
register("assert_not_empty", ["reviews"], """select 'not_empty' "check", 'all' input, count(*) > 0 ok, '' message, count(*) n from reviews
 union all select 'not_empty', 'none', count(*) > 0, 'reviews: no rows', count(*) from reviews where rating > 5""")
register("check_required_columns", ["raw"], """select 'required_columns' "check", input, ok, message, n from (select count(*) n from raw)
 cross join (values ('raw', true, 'Schema valid'), ('no rating', false, 'Missing required columns: rating')) t(input, ok, message)""")
register("write_dashboard_json", ["records"], select_round("records", REC_COLS, REC_DOUBLES))
register("read_reviews_json_mixed", ["norm"], f"select {_norm_stable} from norm")
register("read_review_pages_limited", ["base"], f"""select cast(ok + 1 as integer) page, {PRODUCT_SQL} product,
 round({RATING_SQL}, 6) rating, round(case when ab > 0 then ab else 0.0 end, 6) customer_ltv from base where ok + 1 <= 100""")
cte("schema_rows", ["raw"], """select 'filled_column' "check", c "column", 'info' severity, cast(0 as bigint) n,
  'Created missing column: ' || c message from (values ('customer_ltv'), ('repeat'), ('verified'), ('detected_issues'),
  ('sentiment_score')) t(c)
 union all select 'type_conversion', 'rating', 'info', n, concat('rating: filled ', n, ' values with default')
 from (select count(*) n from raw where try_cast(rating as double) is null) where n > 0""")
register("schema_report", ["schema_rows"], "select * from schema_rows")
register("fill_report", ["raw"], """select c "column", case c when 'rating' then r when '__before' then r + o
  when '__after' then o else 0 end n from (select cast(count_if(try_cast(rating as double) is null) as bigint) r,
  cast(count_if(product_name is null) + count_if(review_text is null) + count_if(sentiment is null) + count_if(ltv is null)
   + count_if(review_date is null) as bigint) o from raw)
 cross join (values ('rating'), ('order_value'), ('helpful_votes'), ('days_since_purchase'), ('__before'), ('__after')) t(c)""")
cte("gate_rows", ["raw"], """select 'non_empty' "check", count(*) > 0 ok, concat(count(*), ' rows') message from raw
 union all select c, true, '' from (values ('required_columns_present'), ('no_critical_nan'), ('correct_dtypes'), ('valid')) t(c)""")
register("validate_output", ["gate_rows"], "select * from gate_rows")
register("robustness_report", ["raw", "schema_rows", "sanity_rows", "null_rows"], f"""
 select 'shape' "check", '__rows' "column", 'info' severity, count(*) n,
  concat(count(*), ' rows x {len(RAW_COLS)} columns') message from raw
 union all select "check", "column", severity, n, message from schema_rows
 union all select "check", "column", severity, n, message from sanity_rows
 union all select 'null_profile', "column", case when critical then 'critical' else 'info' end, null_count,
  format('{{:.1f}}', null_pct) || '% missing' from null_rows""")
_other = " + ".join(cnt_if(f"{c} is null") for c in RAW_COLS if c not in K.ROBUST_DEFAULTS)
register("preprocess_report", ["raw", "schema_rows", "gate_rows"], f"""
 select 'schema' step, "check", "column", severity, n, message from schema_rows
 union all select 'fill', 'filled', c, 'info', n, concat('Missing values: ', n)
  from (select {_other} n from raw) cross join (values ('__before'), ('__after')) t(c) where n > 0
 union all select 'validation', "check", null, case when ok then 'info' else 'critical' end, 0, message
  from gate_rows""")
