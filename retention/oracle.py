"""ANSI SQL oracles (DuckDB dialect) for the deterministic queries.

Every oracle starts from the same customer fixture view over the driver tables
(FIXTURES.md F2) and re-states the operator in plain SQL, so the Spark plan and
the SQL text are written independently. ``with_base(body)`` prefixes the view.
"""

from __future__ import annotations

import itertools
import math

CUSTOMERS_SQL = """
o as (select o_orderkey, o_custkey, cast(round(o_totalprice*100) as bigint) cents, o_orderdate, o_orderpriority,
    row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders),
oc as (select o_custkey, count(distinct year(o_orderdate)*12+month(o_orderdate)) am, sum(cents) total,
    max(case when rn=1 then cents end) last_cents, max(case when rn=1 then o_orderpriority end) prio from o group by o_custkey),
lc as (select o_custkey, sum(case when l_returnflag='R' then 1 else 0 end) r, sum(case when l_returnflag='A' then 1 else 0 end) a,
    sum(case when l_returnflag='N' then 1 else 0 end) n, sum(case when l_linestatus='F' then 1 else 0 end) f, count(*) c
    from lineitem join orders on l_orderkey=o_orderkey group by o_custkey),
b as (select c_custkey, concat('C', cast(c_custkey as varchar(20))) customerID,
  case when c_custkey%2=0 then 'Female' else 'Male' end gender, case when c_acctbal<0 then 1 else 0 end SeniorCitizen,
  case when c_custkey%3=0 then 'Yes' else 'No' end Partner, case when c_custkey%5=0 then 'Yes' else 'No' end Dependents,
  cast(floor(coalesce(am,0)*coalesce(am,0)/5e0) as int) tenure,
  case when c_nationkey%7=0 then 'No' else 'Yes' end PhoneService,
  case when c_nationkey%7=0 then 'No phone service' when coalesce(c,0)%2=0 then 'Yes' else 'No' end MultipleLines,
  case c_nationkey%3 when 0 then 'DSL' when 1 then 'Fiber optic' else 'No' end InternetService,
  case when c_nationkey%3=2 then 'No internet service' when coalesce(a,0)%2=0 then 'Yes' else 'No' end OnlineSecurity,
  case when c_nationkey%3=2 then 'No internet service' when coalesce(n,0)%2=0 then 'Yes' else 'No' end OnlineBackup,
  case when c_nationkey%3=2 then 'No internet service' when coalesce(f,0)%2=0 then 'Yes' else 'No' end DeviceProtection,
  case when c_nationkey%3=2 then 'No internet service' when coalesce(r,0)%2=0 then 'Yes' else 'No' end TechSupport,
  case when c_nationkey%3=2 then 'No internet service' when coalesce(r,0)%3=0 then 'Yes' else 'No' end StreamingTV,
  case when c_nationkey%3=2 then 'No internet service' when coalesce(a,0)%3=0 then 'Yes' else 'No' end StreamingMovies,
  case when prio in ('1-URGENT','2-HIGH') or prio is null then 'Month-to-month' when prio in ('3-MEDIUM','4-NOT SPECIFIED') then 'One year' else 'Two year' end Contract,
  case when c_custkey%4=0 then 'No' else 'Yes' end PaperlessBilling,
  case c_mktsegment when 'AUTOMOBILE' then 'Bank transfer (automatic)' when 'BUILDING' then 'Credit card (automatic)' when 'HOUSEHOLD' then 'Mailed check' else 'Electronic check' end PaymentMethod,
  floor(coalesce(last_cents,5000000)/25e2)/1e2 MonthlyCharges,
  case when total is null then ' ' else cast(floor(total/25e2)/1e2 as varchar(30)) end TotalCharges,
  (c_custkey*7919+13)%1009 u
  from customer left join oc on c_custkey=oc.o_custkey left join lc on c_custkey=lc.o_custkey),
cust as (select *, case when u < 60 + 250*(case when Contract='Month-to-month' then 1 else 0 end)+150*(case when InternetService='Fiber optic' then 1 else 0 end)
   +100*(case when TechSupport='No' then 1 else 0 end)+150*(case when tenure<=6 then 1 else 0 end) then 'Yes' else 'No' end Churn from b)
"""


def with_base(*ctes: str, body: str) -> str:
    """``with <fixture view>, <ctes...> <body>``."""
    parts = [CUSTOMERS_SQL.strip()] + [c.strip() for c in ctes]
    return "with " + ",\n".join(parts) + "\n" + body.strip()


SQL: dict[str, str] = {}


def register(key: str, sql: str) -> str:
    SQL[key] = sql
    return sql


register("customers", with_base(body="select * from cust"))


# ---------------------------------------------------------------- building blocks
LABEL = "case when Churn='Yes' or coalesce(try_cast(Churn as double) = 1, false) then 1 else 0 end"

CLEAN = """
cl as (select * replace (
    coalesce(case when isnan(try_cast(TotalCharges as double)) then null else try_cast(TotalCharges as double) end, 0.0) as TotalCharges,
    case when isnan(MonthlyCharges) then null else MonthlyCharges end as MonthlyCharges) from cust)
"""

SPLIT = f"""
k as (select {LABEL} label, md5(concat(customerID,'/42')) _key, count(*) w from cl group by all),
kp as (select *, coalesce(sum(w) over (partition by label order by _key rows between unbounded preceding and 1 preceding), 0) w_before,
    sum(w) over (partition by label) w_total from k),
ka as (select label, _key, w_before, (w_total+4)//5 nt, (w_total - (w_total+4)//5 + 3)//4 nv from kp),
kb as (select label, _key, case when w_before < nt then 'test' when w_before < nt+nv then 'val' else 'train' end split,
    case when w_before >= nt+nv then cast((w_before-nt-nv) % 5 as int) end fold from ka),
sp as (select cl.*, kb.label, kb.split, kb.fold from cl join kb
    on kb._key = md5(concat(cl.customerID,'/42')) and kb.label = {LABEL.replace('Churn', 'cl.Churn')})
"""

MED = "med as (select quantile_cont(MonthlyCharges, 0.5) median from sp where split='train')"


def bucket_sql(mode: str) -> str:
    first = {"train": "tenure>0 and tenure<=6", "score": "tenure>=0 and tenure<=6", "open": "tenure<=6"}[mode]
    last = {"train": "tenure>24 and tenure<=72", "score": "tenure>24 and tenure<=72", "open": "tenure>24"}[mode]
    return (f"case when {first} then '0-6m' when tenure>6 and tenure<=12 then '6-12m' "
            f"when tenure>12 and tenure<=24 then '12-24m' when {last} then '24m+' end")


SERVICES = ["PhoneService", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
            "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]

FEAT = f"""
ft as (select sp.*, {bucket_sql('score')} tenure_bucket,
  ({' + '.join(f"case when {c} is not distinct from 'Yes' then 1 else 0 end" for c in SERVICES)}) services_count,
  TotalCharges / case when tenure*MonthlyCharges is null then null else greatest(1.0, tenure*MonthlyCharges) end monthly_to_total_ratio,
  case when InternetService is distinct from 'No' and TechSupport is not distinct from 'No' then 1 else 0 end internet_no_tech_support,
  case when PhoneService is not distinct from 'Yes' and OnlineSecurity is not distinct from 'No' then 1 else 0 end phone_no_security,
  case when coalesce(MonthlyCharges > med.median, false) and OnlineBackup is not distinct from 'No' then 1 else 0 end premium_no_backup,
  case when coalesce(tenure > 24, false) and coalesce(MonthlyCharges < med.median, false) then 1 else 0 end long_tenure_low_value,
  36 expected_tenure, MonthlyCharges*36 clv
  from sp cross join med)
"""

CATEGORICAL = ["gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
               "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
               "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod", "tenure_bucket"]
FEATURES = ["gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService", "MultipleLines",
            "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
            "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
            "MonthlyCharges", "TotalCharges", "tenure_bucket", "services_count", "monthly_to_total_ratio",
            "internet_no_tech_support", "phone_no_security", "premium_no_backup", "long_tenure_low_value",
            "expected_tenure", "clv"]
NUMERIC = [f for f in FEATURES if f not in CATEGORICAL]


def stack_sql(src: str, where: str = "") -> str:
    w = f" where {where}" if where else ""
    return " union all ".join(
        f"select '{c}' as \"column\", coalesce(cast({c} as varchar), 'nan') as value from {src}{w}" for c in CATEGORICAL)


ENCODER = f"""
ev as (select "column", value, cast(dense_rank() over (partition by "column" order by value) - 1 as int) code
   from (select distinct "column", value from ({stack_sql('ft', "split='train'")})))
"""


def encoded_sql(src: str = "ft", enc: str = "ev", name: str = "en") -> str:
    repl = ", ".join(
        f"coalesce((select code from {enc} where {enc}.\"column\"='{c}' and {enc}.value = coalesce(cast({src}.{c} as varchar),'nan')), 0) as {c}"
        for c in CATEGORICAL)
    return f"{name} as (select * replace ({repl}) from {src})"


ENC = encoded_sql()

PREP = [CLEAN, SPLIT, MED, FEAT]            # up to engineered features
PREP_ENC = PREP + [ENCODER, ENC]            # + encoder table and encoded table


# ---------------------------------------------------------------- sources, cleaning
register("load_customers", with_base(CLEAN, body="select * exclude (c_custkey, u) from cl"))
register("clean_total_charges", with_base(body="""
select customerID, TotalCharges total_charges_text,
  coalesce(case when isnan(try_cast(TotalCharges as double)) then null else try_cast(TotalCharges as double) end, 0.0) TotalCharges
from cust"""))
for _m in ("train", "score", "open"):
    register(f"tenure_bucket_{_m}", with_base(CLEAN, body=f"select customerID, tenure, {bucket_sql(_m)} tenure_bucket from cl"))

register("services_count", with_base(*PREP, body="select customerID, services_count from ft"))
register("charge_ratio", with_base(*PREP, body="select customerID, TotalCharges, tenure, MonthlyCharges, monthly_to_total_ratio from ft"))
register("risk_flags", with_base(*PREP, body="select customerID, internet_no_tech_support, phone_no_security, premium_no_backup, long_tenure_low_value from ft"))
register("clv", with_base(*PREP, body="select customerID, MonthlyCharges, expected_tenure, clv from ft"))
register("churn_label", with_base(body=f"select customerID, Churn, {LABEL} label from cust"))
register("median_monthly", with_base(CLEAN, SPLIT, body="select quantile_cont(MonthlyCharges, 0.5) median from sp where split='train'"))


def _median_union(cols, src, where):
    return " union all ".join(
        f"select '{c}' as \"column\", quantile_cont(case when isinf(cast({c} as double)) or isnan(cast({c} as double)) then null else cast({c} as double) end, 0.5) as value from {src} where {where}"
        for c in cols)


register("median_table", with_base(*PREP_ENC, body=_median_union(FEATURES, "en", "split='train'")))
register("impute_median", with_base(*PREP_ENC, f"md as ({_median_union(NUMERIC, 'en', chr(39) + 'train' + chr(39) + ' = split')})", body=
    "select customerID, " + ", ".join(
        f"coalesce(case when isinf(cast({c} as double)) or isnan(cast({c} as double)) then null else cast({c} as double) end, "
        f"(select value from md where \"column\"='{c}')) as {c}" for c in NUMERIC) + " from en"))

# ---------------------------------------------------------------- split
register("stratified_split", with_base(CLEAN, SPLIT, body="select customerID, label, split, fold from sp"))
register("stratified_folds", with_base(CLEAN, SPLIT, body="select fold, label, count(*) customers from sp where split='train' group by all"))
register("scan_split", with_base(*PREP, body="select customerID, tenure, MonthlyCharges, clv, label from ft where split='train'"))
register("train_val_union", with_base(CLEAN, SPLIT, body="select customerID, split, label from sp where split in ('train','val')"))
register("split_report", with_base(CLEAN, SPLIT, body="""
select c.split, c.Churn, c.n, t.split_total, round_even(c.n / t.split_total, 6) share
from (select split, Churn, count(*) n from sp group by all) c join (select split, count(*) split_total from sp group by all) t using (split)"""))
register("seeded_sample", with_base(CLEAN, SPLIT, body="select customerID, label, split from sp where split='test' order by md5(concat(customerID,'/42')), customerID limit 100"))
register("class_weights", with_base(CLEAN, SPLIT, body="""
select label, n_c, t.n / (t.k * n_c) weight from (select label, count(*) n_c from sp where split='train' group by label) c
cross join (select count(*) n, count(distinct label) k from sp where split='train') t"""))
register("scale_pos_weight", with_base(CLEAN, SPLIT, body="""
select neg, pos, cast(floor(neg / pos) as double) scale_pos_weight from (select cast(sum(case when label=0 then 1 else 0 end) as bigint) neg,
  cast(sum(case when label=1 then 1 else 0 end) as bigint) pos from sp where split='train')"""))
register("attach_label", with_base(*PREP, body=f"select ft.customerID, ft.clv, ft.split, {LABEL.replace('Churn', 'cust.Churn')} churn from ft join cust using (customerID)"))

# ---------------------------------------------------------------- encoding
register("encoder_table", with_base(*PREP, ENCODER, body="select * from ev"))
register("encode_features", with_base(*PREP_ENC, body="select customerID, " + ", ".join(CATEGORICAL) + " from en"))
register("encoder_stage", with_base(*PREP_ENC, body="select customerID, " + ", ".join(CATEGORICAL) + " from en"))
register("encode_selffit", with_base(*PREP, f"""
es as (select "column", value, cast(dense_rank() over (partition by "column" order by value) - 1 as int) code
   from (select distinct "column", value from ({stack_sql('ft')})))""", encoded_sql("ft", "es", "ens"),
    body="select customerID, " + ", ".join(CATEGORICAL) + " from ens"))
register("unseen_categories", with_base(*PREP, ENCODER, """
fu as (select * replace (case when c_custkey % 17 = 0 then 'Three year' else Contract end as Contract,
  case when c_custkey % 19 = 0 then 'Voucher' else PaymentMethod end as PaymentMethod) from ft)""", body=f"""
select s."column", s.value, count(*) "rows" from ({stack_sql('fu', "split<>'train'")}) s
where not exists (select 1 from ev where ev."column"=s."column" and ev.value=s.value) group by all"""))
_Z = ["tenure", "MonthlyCharges", "TotalCharges", "clv", "expected_tenure"]
register("standardize", with_base(*PREP_ENC, "st as (select " + ", ".join(
    f"avg(cast({c} as double)) m_{c}, stddev_pop(cast({c} as double)) s_{c}" for c in _Z) + " from en where split='train')",
    body="select customerID, " + ", ".join(
        f"round_even(case when s_{c} = 0 then 0.0 else (cast({c} as double) - m_{c}) / s_{c} end, 9) as {c}" for c in _Z)
    + " from en cross join st"))
register("feature_matrix", with_base(*PREP_ENC, body="select customerID, " + ", ".join(FEATURES) + " from en"))

# ---------------------------------------------------------------- CLV
QE = """
qe as (select quantile_cont(clv, 0.25) q1, quantile_cont(clv, 0.5) q2, quantile_cont(clv, 0.75) q3 from ft where clv is not null)
"""
SEG = """
sg as (select ft.*, case when clv <= q1 then 'Low' when clv <= q2 then 'Medium' when clv <= q3 then 'High'
   when clv is not null then 'Premium' end clv_quartile from ft cross join qe),
sg2 as (select *, case clv_quartile when 'Low' then 1 when 'Medium' then 2 when 'High' then 3 when 'Premium' then 4 end segment_pos from sg)
"""
CBC = """
cbc as (select clv_quartile, segment_pos, round_even(avg(label), 4) churn_rate, cast(sum(label) as bigint) churned_count,
   count(*) total_customers, round_even(avg(clv), 4) avg_clv, round_even(quantile_cont(clv, 0.5), 4) median_clv,
   round_even(round_even(avg(label), 4) * 100, 2) churn_rate_pct, count(*) - cast(sum(label) as bigint) retained_count
   from sg2 group by clv_quartile, segment_pos)
"""
CLVP = PREP + [QE, SEG]
register("clv_quartile_edges", with_base(*PREP, QE, body="select * from qe"))
register("clv_quartile", with_base(*CLVP, body="select customerID, clv, clv_quartile, segment_pos from sg2"))
register("clv_quartile_bounds", with_base(*CLVP, body="""
select clv_quartile, segment_pos, min(clv) min_clv, max(clv) max_clv, round_even(avg(clv), 4) mean_clv from sg2 group by all"""))
register("churn_by_clv", with_base(*CLVP, CBC, body="select * from cbc"))
register("clv_summary", with_base(*PREP, body="""
select count(clv) customers, min(clv) min_clv, max(clv) max_clv, round_even(avg(clv), 4) avg_clv, round_even(sum(clv), 4) total_clv from ft"""))
register("overall_churn", with_base(*PREP, body="select count(*) customers, cast(sum(label) as bigint) churned, avg(label) churn_rate from ft"))
register("segment_clv_share", with_base(*CLVP, body="""
select clv_quartile, segment_pos, round_even(sum(clv), 4) segment_clv, round_even(sum(clv) / (select sum(clv) from ft) * 100, 4) share_pct
from sg2 group by all"""))
register("clv_histogram", with_base(*PREP, "rg as (select min(clv) lo, max(clv) hi from ft)", """
hb as (select cast(case when (hi - lo) / 50 = 0 then 0 else least(floor((clv - lo) / ((hi - lo) / 50)), 49) end as int) bin, count(*) k
  from ft cross join rg where clv is not null group by 1)""", body="""
select cast(range as int) bin, lo + range * (hi - lo) / 50 bin_start, coalesce(k, 0) customers
from rg cross join range(50) left join hb on hb.bin = range where lo is not null"""))
register("revenue_at_risk", with_base(*CLVP, CBC, body="""
select clv_quartile, segment_pos, total_customers, churn_rate_pct, avg_clv, churned_count,
  round_even(total_customers * (churn_rate_pct / 100) * avg_clv, 2) revenue_at_risk from cbc"""))
PREMIUM = """
select total_customers premium_customers, churn_rate_pct, avg_clv,
  cast(trunc(total_customers * (churn_rate_pct / 100) * avg_clv) as bigint) premium_at_risk,
  cast(trunc(churned_count * 0.10 * avg_clv) as bigint) saving_10pct_churn_cut,
  cast(trunc(total_customers * 0.01 * avg_clv) as bigint) saving_per_1pct
from cbc where clv_quartile = 'Premium'
"""
register("premium_takeaway", with_base(*CLVP, CBC, body=PREMIUM))
register("clv_insights", with_base(*CLVP, CBC, f"pt as ({PREMIUM})", body="""
select 1 pos, 'total_customers' name, cast(count(*) as double) value from ft
union all select 2, 'avg_clv', round_even(avg(clv), 4) from ft
union all select 3, 'min_clv', min(clv) from ft
union all select 4, 'max_clv', max(clv) from ft
union all select 5, 'expected_tenure', cast(max(expected_tenure) as double) from ft
union all select 10 + segment_pos * 2, lower(clv_quartile) || '_churn_rate_pct', churn_rate_pct from cbc
union all select 11 + segment_pos * 2, lower(clv_quartile) || '_avg_clv', avg_clv from cbc
union all select 30, 'premium_saving_10pct', cast(saving_10pct_churn_cut as double) from pt"""))


# ---------------------------------------------------------------- scoring
# the two scorecards, restated: coefficients and intercept
COEFFICIENTS = {
    "scorecard": ({"Contract": -1.1, "internet_no_tech_support": 0.9, "tenure": -0.035, "MonthlyCharges": 0.006,
                   "SeniorCitizen": 0.3, "PaymentMethod": 0.12}, 0.2),
    "scorecard_b": ({"Contract": -0.8, "InternetService": -0.4, "TechSupport": -0.3, "tenure_bucket": 0.1,
                     "services_count": -0.05, "clv": 0.0002}, 0.6),
}


def _d(x: float) -> str:
    return f"cast({float(x)!r} as double)"


def margin_sql(name: str, present=None) -> str:
    coef, intercept = COEFFICIENTS[name]
    terms = [_d(intercept)]
    for f in FEATURES:
        if coef.get(f):
            x = f"cast({f} as double)" if present is None or f in present else "cast(0 as double)"
            terms.append(f"{_d(coef[f])} * {x}")
    return " + ".join(terms)


def prob_sql(name: str, present=None) -> str:
    return f"round(cast(1 as double) / (cast(1 as double) + exp(-({margin_sql(name, present)}))), 9)"


def scored_sql(models) -> str:
    parts = [f"select customerID customer_id, '{m}' model_used, label, split, clv, {prob_sql(m)} churn_probability from en"
             for m in models]
    return f"""sc0 as ({' union all '.join(parts)}),
sc as (select customer_id, model_used, label, split, clv, cast(churn_probability > 0.5 as int) churn_prediction, churn_probability,
  cast(1 as double) - churn_probability no_churn_probability,
  case when churn_probability > 0.5 then 'Churn' else 'No Churn' end prediction_label from sc0)"""


MODELS = list(COEFFICIENTS)
SC1 = scored_sql(["scorecard"])
SCA = scored_sql(MODELS)
OUT6 = "customer_id, model_used, churn_prediction, churn_probability, no_churn_probability, prediction_label"
register("score_batch", with_base(*PREP_ENC, SC1, body=f"select {OUT6} from sc"))
register("score_all_models", with_base(*PREP_ENC, SCA, body=f"select {OUT6} from sc"))
_PART = {"tenure", "MonthlyCharges", "TotalCharges", "tenure_bucket", "services_count", "monthly_to_total_ratio",
         "long_tenure_low_value", "expected_tenure", "clv"}
register("score_partial_input", with_base(CLEAN, SPLIT, MED, f"""
pp as (select customerID, tenure, MonthlyCharges, coalesce(case when isnan(try_cast(TotalCharges as double)) then null else try_cast(TotalCharges as double) end, 0.0) TotalCharges from cust),
pq as (select *, {prob_sql('scorecard', _PART)} churn_probability from pp cross join med)""", body="""
select customerID customer_id, 'scorecard' model_used, cast(churn_probability > 0.5 as int) churn_prediction, churn_probability,
  cast(1 as double) - churn_probability no_churn_probability, case when churn_probability > 0.5 then 'Churn' else 'No Churn' end prediction_label from pq"""))
GAPS = """
gp as (select * replace (case when c_custkey % 11 <> 0 then tenure end as tenure,
  case when c_custkey % 13 <> 0 then MonthlyCharges end as MonthlyCharges) from cl)
"""
register("reject_incomplete", with_base(CLEAN, GAPS, body="""
select customerID, concat_ws(',', case when tenure is null then 'missing tenure' end, case when MonthlyCharges is null then 'missing MonthlyCharges' end) reason
from gp where tenure is null or MonthlyCharges is null"""))
# a row without gaps scores as it always does
register("score_accepted", with_base(*PREP_ENC, SC1, body=f"select {OUT6} from sc where cast(substr(customer_id, 2) as bigint) % 11 <> 0 and cast(substr(customer_id, 2) as bigint) % 13 <> 0"))
# of the scorecard's features only tenure, MonthlyCharges (medians) and internet_no_tech_support, Contract, SeniorCitizen,
# PaymentMethod (not touched by the gaps) count
register("score_imputed", with_base(*PREP_ENC, """
mt as (select quantile_cont(tenure, 0.5) mt, quantile_cont(MonthlyCharges, 0.5) mm from en where split='train')""", f"""
eg as (select * replace (case when c_custkey % 11 = 0 then mt else tenure end as tenure,
  case when c_custkey % 13 = 0 then mm else MonthlyCharges end as MonthlyCharges) from en cross join mt)""", f"""
sg0 as (select customerID customer_id, {prob_sql('scorecard')} churn_probability from eg)""", body="""
select customer_id, 'scorecard' model_used, cast(churn_probability > 0.5 as int) churn_prediction, churn_probability,
  cast(1 as double) - churn_probability no_churn_probability,
  case when churn_probability > 0.5 then 'Churn' else 'No Churn' end prediction_label from sg0"""))
TIERS = """
ti as (select customer_id, model_used, churn_probability,
  case when churn_prediction = 1 then 'High Risk' else 'Low Risk' end risk_label,
  case when churn_probability > 0.75 or churn_probability < 0.25 then 'High' else 'Medium' end confidence,
  case when churn_probability * 100 < 33 then 'low' when churn_probability * 100 < 66 then 'medium' else 'high' end gauge_band,
  churn_probability * 100 >= 70 above_alert_line,
  case when clv > 2500 then 'HIGH' when clv > 1500 then 'MEDIUM' else 'STANDARD' end value_priority,
  case when churn_probability > 0.7 then 'URGENT' when churn_probability > 0.4 then 'MODERATE' else 'LOW' end action_tier from sc)
"""
register("score_tiers", with_base(*PREP_ENC, SC1, TIERS, body="select * from ti"))

from .functions import constants as _K  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ACTS = "acts as (select * from (values " + ", ".join(
    f"({_q(t)}, {i + 1}, {_q(_K.ACTION_HEADLINES[t])}, {_q(a)})" for t, acts in _K.ACTIONS.items()
    for i, a in enumerate(acts)) + ") as t(action_tier, pos, headline, action))"
register("recommended_actions", with_base(*PREP_ENC, SC1, TIERS, ACTS, body="""
select ti.action_tier, ti.customer_id, acts.pos, acts.headline, acts.action from ti join acts using (action_tier)"""))
_RF = _K.RISK_FACTOR_TEXTS
RISK = f"""
rf0 as (select customerID customer_id, unnest([
  case when Contract is not distinct from 'Month-to-month' then {{'pos': 1, 'factor': {_q(_RF[0])}}} end,
  case when InternetService is not distinct from 'Fiber optic' and TechSupport is not distinct from 'No' then {{'pos': 2, 'factor': {_q(_RF[1])}}} end,
  case when PaymentMethod is not distinct from 'Electronic check' then {{'pos': 3, 'factor': {_q(_RF[2])}}} end,
  case when coalesce(tenure < 6, false) then {{'pos': 4, 'factor': {_q(_RF[3])}}} end,
  case when coalesce(MonthlyCharges > 80, false) then {{'pos': 5, 'factor': {_q(_RF[4])}}} end,
  case when OnlineSecurity is not distinct from 'No' and OnlineBackup is not distinct from 'No' then {{'pos': 6, 'factor': {_q(_RF[5])}}} end]) r from cl),
rf1 as (select customer_id, r.pos pos, r.factor factor from rf0 where r is not null),
rf as (select * from rf1 union all select customerID, 0, {_q(_K.RISK_FACTOR_DEFAULT)} from cl
   where customerID not in (select customer_id from rf1))
"""
register("risk_factors", with_base(CLEAN, RISK, body="select * from rf"))
register("risk_factor_counts", with_base(CLEAN, RISK, body="select pos, factor, count(*) customers from rf group by all"))
_dv = []
for _c, _allowed in _K.CATEGORY_DOMAINS.items():
    _dv.append(f"select customerID customer_id, '{_c}' \"column\", cast({_c} as varchar) value from cl "
               f"where not coalesce({_c} in ({', '.join(_q(a) for a in _allowed)}), false)")
for _c, (_lo, _hi) in _K.NUMERIC_DOMAINS.items():
    _dv.append(f"select customerID, '{_c}', cast({_c} as varchar) from cl where {_c} is null or {_c} < {_lo} or {_c} > {_hi}")
register("domain_violations", with_base(CLEAN, body=" union all ".join(_dv)))
_FORM = ["customerID", "tenure", "MonthlyCharges", "Contract", "InternetService", "TechSupport", "OnlineSecurity",
         "OnlineBackup", "PhoneService", "MultipleLines", "PaymentMethod", "SeniorCitizen", "Partner"]
register("apply_form_defaults", with_base(body="select " + ", ".join(_FORM) + ", " + ", ".join(
    f"{_q(v)} {c}" for c, v in _K.FORM_DEFAULTS.items()) + ", cast(tenure as double) * MonthlyCharges TotalCharges from cust"))
register("score_summary", with_base(*PREP_ENC, SCA, body="""
select model_used, count(*) customers, cast(sum(churn_prediction) as bigint) predicted_churners from sc group by model_used"""))

# ---------------------------------------------------------------- metrics
CM = """
cm as (select model_used, split, cast(sum(case when label=0 and churn_prediction=0 then 1 else 0 end) as bigint) tn,
  cast(sum(case when label=0 and churn_prediction=1 then 1 else 0 end) as bigint) fp, cast(sum(case when label=1 and churn_prediction=0 then 1 else 0 end) as bigint) fn,
  cast(sum(case when label=1 and churn_prediction=1 then 1 else 0 end) as bigint) tp from sc group by model_used, split)
"""
SCNT = """
scd as (select model_used, split, churn_probability, sum(case when label=1 then 1 else 0 end) pos, sum(case when label=0 then 1 else 0 end) neg
   from sc group by all),
scp as (select *, coalesce(sum(pos) over w, 0) pos_before, coalesce(sum(neg) over w, 0) neg_before,
   sum(pos) over (partition by model_used, split) pos_total, sum(neg) over (partition by model_used, split) neg_total from scd
   window w as (partition by model_used, split order by churn_probability desc rows between unbounded preceding and 1 preceding))
"""
AUC = """
au as (select model_used, split, case when 2*max(pos_total)*max(neg_total) = 0 then null else
   cast(sum(neg * (2*pos_before + pos)) as double) / cast(2*max(pos_total)*max(neg_total) as double) end auc from scp group by all)
"""


def _ratio_sql(n, d):
    return f"case when {d} = 0 then 0.0 else {n} / {d} end"


MLONG = f"""
rt as (select cm.*, au.auc auc_roc,
  {_ratio_sql('cast(tp as double)', 'cast(tp + fp as double)')} "precision",
  {_ratio_sql('cast(tp as double)', 'cast(tp + fn as double)')} recall,
  {_ratio_sql('2 * cast(tp as double)', '(2 * cast(tp as double) + cast(fp as double) + cast(fn as double))')} f1,
  ({_ratio_sql('cast(tp as double)', 'cast(tp + fn as double)')} + {_ratio_sql('cast(tn as double)', 'cast(tn + fp as double)')}) / 2 balanced_accuracy
  from cm join au using (model_used, split)),
ml as (select model_used model, 'train' fit_on, split, m.metric metric, m.value value from rt, unnest([
  {{'metric': 'precision', 'value': "precision"}}, {{'metric': 'recall', 'value': recall}}, {{'metric': 'f1', 'value': f1}},
  {{'metric': 'auc_roc', 'value': auc_roc}}, {{'metric': 'balanced_accuracy', 'value': balanced_accuracy}},
  {{'metric': 'tn', 'value': cast(tn as double)}}, {{'metric': 'fp', 'value': cast(fp as double)}},
  {{'metric': 'fn', 'value': cast(fn as double)}}, {{'metric': 'tp', 'value': cast(tp as double)}}]) as u(m))
"""
METRICS = PREP_ENC + [SCA, CM, SCNT, AUC, MLONG]
register("confusion_matrix", with_base(*PREP_ENC, SCA, CM, body="select * from cm"))
register("classification_metrics", with_base(*METRICS, body="select * from ml"))
register("auc", with_base(*PREP_ENC, SCA, SCNT, AUC, body="select * from au"))
register("roc_curve", with_base(*PREP_ENC, SCA, SCNT, body="""
select model_used, split, churn_probability threshold,
  case when neg_total = 0 then 0.0 else cast(neg_before + neg as double) / cast(neg_total as double) end fpr,
  case when pos_total = 0 then 0.0 else cast(pos_before + pos as double) / cast(pos_total as double) end tpr from scp
union all select distinct model_used, split, 'inf'::double, 0.0, 0.0 from scp"""))
register("model_summary", with_base(*METRICS, body="""
select array_to_string(list_transform(string_split(model, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') model_name, model,
  max(case when split='val' and metric='auc_roc' then value end) val_auc_roc, max(case when split='test' and metric='auc_roc' then value end) test_auc_roc,
  max(case when split='test' and metric='recall' then value end) test_recall, max(case when split='test' and metric='precision' then value end) test_precision,
  max(case when split='test' and metric='f1' then value end) test_f1 from ml group by model"""))
_ORDER = "case model " + " ".join(f"when '{m}' then {i + 1}" for i, m in enumerate(MODELS)) + " end"
BEST = f"""
bm as (select split, metric, model best_model, value best_value from (select *, row_number() over (partition by split, metric
  order by value desc, {_ORDER}) rn from ml where metric in ('auc_roc','f1','precision','recall')) where rn = 1)
"""
register("best_model", with_base(*METRICS, BEST, body="select * from bm"))
register("target_alerts", with_base(*METRICS, BEST, body="""
select ml.model, ml.metric, ml.value, case ml.metric when 'auc_roc' then cast(0.8 as double) else cast(0.6 as double) end target from ml
join bm on bm.split='val' and bm.metric='auc_roc' and ml.model=bm.best_model
where ml.split='val' and ml.metric in ('auc_roc','recall') and ml.value < case ml.metric when 'auc_roc' then 0.8 else 0.6 end"""))


# ---------------------------------------------------------------- explanations
def _coef(m, f):
    return _d(COEFFICIENTS[m][0].get(f, 0.0))


def importance_sql(m: str) -> str:
    return " union all ".join(
        f"select '{m}' model, '{f}' feature, round_even(abs({_coef(m, f)} * stddev_pop(cast({f} as double))), 9) importance, "
        f"{_coef(m, f)} coefficient, round_even(stddev_pop(cast({f} as double)), 9) std_dev from en where split='train'"
        for f in FEATURES)


IMP = f"imp as ({' union all '.join(importance_sql(m) for m in MODELS)})"


def contrib_sql(m: str) -> str:
    return " union all ".join(
        f"select customerID, '{m}' model, '{f}' feature, cast({f} as double) value, {_coef(m, f)} coefficient, {_coef(m, f)} * cast({f} as double) contribution from en"
        for f in FEATURES)


CON = f"con as ({contrib_sql('scorecard')})"
CONA = f"cona as ({' union all '.join(contrib_sql(m) for m in MODELS)})"
TOPF = """
tf as (select *, cast(row_number() over (partition by customerID, model order by abs(contribution) desc, feature) as int) rank from con)
"""
register("lr_importance", with_base(*PREP_ENC, IMP, body="select * from imp"))
register("lr_contributions", with_base(*PREP_ENC, CON, body="""
select customerID, model, feature, round_even(value, 9) + cast(0 as double) value, coefficient, round_even(contribution, 9) + cast(0 as double) contribution from con"""))
register("top_factors", with_base(*PREP_ENC, CON, TOPF, body="""
select customerID, model, rank, feature, round_even(value, 9) + cast(0 as double) value, coefficient, round_even(contribution, 9) + cast(0 as double) contribution from tf where rank <= 15"""))
# the dense scorecard: coefficient (7 i mod 23 - 11) / 50 of the i-th feature, intercept 0.25
COND = "cond as (" + " union all ".join(
    f"select customerID, '{f}' feature, {(7 * i % 23 - 11) / 50!r}::double * cast({f} as double) c from en"
    for i, f in enumerate(FEATURES)) + ")"
register("waterfall", with_base(*PREP_ENC, COND, """
wr as (select *, cast(row_number() over (partition by customerID order by abs(c) desc, feature) as int) rank from cond),
wo as (select customerID, 15 rank, 'other_features' feature, sum(c) c from wr where rank >= 15 group by customerID),
wa as (select customerID, rank, feature, c from wr where rank < 15 union all select * from wo
  union all select customerID, 0, 'base_value', 0.25::double from en)""", body="""
select customerID, 'scorecard_dense' model, rank, feature, round_even(c, 9) + 0::double contribution,
  round_even(sum(c) over (partition by customerID order by rank rows between unbounded preceding and current row), 9) + 0::double running
from wa"""))
register("mean_abs_contribution", with_base(*PREP_ENC, CONA, body="""
select model, feature, round_even(avg(abs(round_even(contribution, 9))), 7) importance from cona group by all"""))
TOPI = """
ti2 as (select model, cast(row_number() over (partition by model order by importance desc, feature) as int) rank, feature, importance from imp)
"""
register("top_importance", with_base(*PREP_ENC, IMP, TOPI, body="select * from ti2 where rank <= 15"))
register("compare_importance", with_base(*PREP_ENC, IMP, TOPI, body="select feature, " + ", ".join(
    f"coalesce(max(case when model='{m}' then importance end), 0.0) {m}" for m in MODELS) +
    ", round_even((" + " + ".join(f"coalesce(max(case when model='{m}' then importance end), 0.0)" for m in MODELS) +
    f") / {len(MODELS)}, 9) avg_importance from imp where feature in (select feature from ti2 where rank <= 15) group by feature "
    "order by avg_importance desc, feature limit 15"))


# ---------------------------------------------------------------- SMOTE
ZST = "zs as (select " + ", ".join(
    f"avg(cast({f} as double)) m_{f}, stddev_pop(cast({f} as double)) s_{f}" for f in FEATURES) + " from en where split='train')"
ZT = "zt as (select customerID, label, " + ", ".join(
    f"round_even(case when s_{f} = 0 then 0.0 else (cast({f} as double) - m_{f}) / s_{f} end, 9) as {f}" for f in FEATURES) + \
    " from en cross join zs where split='train')"
_DIST = "sqrt(cast(0 as double) + " + " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in FEATURES) + ")"
register("smote_knn", with_base(*PREP_ENC, ZST, ZT, f"""
pr as (select a.customerID, b.customerID neighbor_id, {_DIST} distance from zt a join zt b
   on a.customerID <> b.customerID where a.label = 1 and b.label = 1),
rk as (select *, cast(row_number() over (partition by customerID order by distance, neighbor_id) as int) rank from pr)""",
    body="select customerID, rank, neighbor_id, round_even(distance, 9) distance from rk where rank <= 5"))
register("smote_counts", with_base(*PREP_ENC, body="""
select label, count(*) before, case when label = 1 then greatest(count(*), (select count(*) from en where split='train' and label = 0))
  else count(*) end after from en where split='train' group by label"""))

# synthetic points: dealt round-robin in md5 order, neighbour and gap from md5(id/t/42)
_SYN = ", ".join(f"a.{f} + g.u * (b.{f} - a.{f}) as {f}" for f in FEATURES)
register("smote_points", with_base(*PREP_ENC, ZST, ZT, f"""
pr as (select a.customerID, b.customerID neighbor_id, {_DIST} distance from zt a join zt b
   on a.customerID <> b.customerID where a.label = 1 and b.label = 1),
rk as (select *, cast(row_number() over (partition by customerID order by distance, neighbor_id) as int) rank from pr),
nn as (select * from rk where rank <= 5)""", """
cn as (select cast(sum(case when label=1 then 1 else 0 end) as bigint) n1, cast(sum(case when label=0 then 1 else 0 end) as bigint) n0 from zt),
od as (select customerID, row_number() over (order by md5(concat(customerID, '/42'))) - 1 nth from zt where label = 1),
rp as (select customerID, (n0 - n1) // n1 + case when nth < (n0 - n1) % n1 then 1 else 0 end reps from od cross join cn),
gt as (select customerID, unnest(range(reps)) t from rp),
gh as (select *, md5(concat(customerID, '/', cast(t as varchar), '/42')) h from gt),
g as (select customerID, t, cast(concat('0x', substr(h, 1, 8)) as bigint) % (select least(5, n1 - 1) from cn) + 1 rank,
   cast(cast(concat('0x', substr(h, 9, 8)) as bigint) as double) / 4294967296.0::double u from gh)""", body=f"""
select concat(g.customerID, '#smote', cast(g.t as varchar)) customerID, 1 label, {_SYN}
from g join zt a on a.customerID = g.customerID join nn on nn.customerID = g.customerID and nn.rank = g.rank
join zt b on b.customerID = nn.neighbor_id"""))

# ---------------------------------------------------------------- bags, histograms
def unit_sql(key: str, tree: str) -> str:
    return f"cast('0x' || substring(md5(concat({key}, '/', {tree}, '/42')), 1, 8) as bigint)"


def poisson_sql(u: str) -> str:
    # e^-1 / k! added up over k = 0..7
    total, ends = 0.0, []
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        ends.append(math.floor(total * 2 ** 32))
    return " + ".join(f"cast({u} >= {e} as int)" for e in ends)


register("forest_bags", with_base(*PREP_ENC, f"""
bag as (select t.tree, label, {poisson_sql('u')} w from (select cast(range as int) tree, label, {unit_sql('customerID', 'range')} u
  from (select * from en where split='train') cross join range(100)) t)""", body="""
select tree, label, cast(sum(w) as bigint) n from bag group by tree, label"""))

_FEW = [*CATEGORICAL, "internet_no_tech_support", "phone_no_security", "premium_no_backup", "long_tenure_low_value", "SeniorCitizen",
        "services_count"]
register("boost_histogram", with_base(*PREP_ENC, f"""
tr as (select * from en where split='train'),
bw as (select floor(count(*) filter (label=0) / cast(count(*) filter (label=1) as double)) spw from tr),
va as ({' union all '.join(f"select customerID, label, '{f}' feature, cast({f} as double) v from tr" for f in _FEW)}),
mx as (select feature, max(v) top from va group by feature)""", body=f"""
select va.feature, case when v = top then null else v end upper, count(*) n,
  sum(case when label=1 then -0.5 * spw else 0.5 end) g, sum(case when label=1 then 0.25 * spw else 0.25 end) h
from va join mx using (feature) cross join bw where {unit_sql('customerID', "'0'")} < floor(0.8 * 4294967296)
group by va.feature, v, top"""))

# ---------------------------------------------------------------- the frozen trees, restated: a leaf is (value, cover), an inner
# node (feature, threshold, low, high). Attributions by the definition: over all sets of the tree's features.
FROZEN = [
    ("tenure", 12, ("Contract", 0, (0.62, 310), (0.21, 190)), ("MonthlyCharges", 70, (-0.35, 270), (-0.08, 230))),
    ("internet_no_tech_support", 0, (-0.17, 600), ("tenure", 24, (0.43, 260), (0.05, 140))),
    ("Contract", 1, ("PaymentMethod", 1, (0.02, 220), ("Contract", 0, (0.31, 240), (-0.12, 160))), (-0.4, 380)),
    ("clv", 2500, ("services_count", 3, (0.07, 330), (-0.03, 170)), ("TotalCharges", 1000, (0.19, 210), (-0.22, 290))),
]


def _cover(node) -> float:
    return node[1] if len(node) == 2 else _cover(node[2]) + _cover(node[3])


def _uses(node) -> set[str]:
    return set() if len(node) == 2 else {node[0]} | _uses(node[2]) | _uses(node[3])


def _game(node, known: frozenset) -> str:
    """The tree's mean output when only the features ``known`` are: other splits are weighted by their covers."""
    if len(node) == 2:
        return _d(node[0])
    low, high = (_game(x, known) for x in node[2:])
    if node[0] in known:
        return f"case when coalesce(cast({node[0]} as double), 0) <= {_d(node[1])} then {low} else {high} end"
    return f"(({_d(_cover(node[2]))} * {low} + {_d(_cover(node[3]))} * {high}) / {_d(_cover(node))})"


def frozen_phi_sql(f: str) -> str:
    parts = ["cast(0 as double)"]
    for tree in FROZEN:
        if f in (used := _uses(tree)):
            k, others = len(used), sorted(used - {f})
            for r in range(k):
                for known in itertools.combinations(others, r):
                    w = math.factorial(r) * math.factorial(k - r - 1) / math.factorial(k)
                    parts.append(f"{_d(w)} * ({_game(tree, frozenset(known) | {f})} - {_game(tree, frozenset(known))})")
    return " + ".join(parts)


FROZEN_BASE = " + ".join(_game(tree, frozenset()) for tree in FROZEN)
CONF = "conf as (" + " union all ".join(
    f"select customerID, '{f}' feature, coalesce(cast({f} as double), 0) v, round_even({frozen_phi_sql(f)}, 9) + cast(0 as double) c from en"
    for f in FEATURES) + ")"
RANKF = """
fr as (select *, cast(row_number() over (partition by customerID order by abs(c) desc, feature) as int) rank from conf)"""
register("frozen_tree_contributions", with_base(*PREP_ENC, CONF, body="""
select customerID, 'frozen_trees' model, feature, v as value, c as contribution from conf"""))
register("tree_top_factors", with_base(*PREP_ENC, CONF, RANKF, body="""
select customerID, 'frozen_trees' model, rank, feature, round_even(v, 9) + cast(0 as double) value, c contribution from fr where rank <= 15"""))
register("tree_waterfall", with_base(*PREP_ENC, CONF, RANKF, f"""
fo as (select customerID, 15 rank, 'other_features' feature, sum(c) c from fr where rank >= 15 group by customerID),
fa as (select customerID, rank, feature, c from fr where rank < 15 union all select * from fo
  union all select customerID, 0, 'base_value', {FROZEN_BASE} from en)""", body="""
select customerID, 'frozen_trees' model, rank, feature, round_even(c, 9) + 0::double contribution,
  round_even(sum(c) over (partition by customerID order by rank rows between unbounded preceding and current row), 9) + 0::double running
from fa"""))

# ---------------------------------------------------------------- invariants: every one holds
for _name, _rows in {
    "check_logistic": ["gradient_is_zero", "learns_the_train_split", "l1_keeps_coefficients"],
    "check_trees": [f"{m}_{c}" for m in ("random_forest", "xgboost")
                    for c in ("adds_up", "explains_every_customer", "refit_agrees", "importance_is_one")],
    "check_shapley": ["adds_up", "explains_every_test_row", "errors_as_stated", "base_is_the_train_mean"],
    "check_search": ["folds_sides_metrics", "best_is_the_mean", "no_constant_model"],
}.items():
    register(_name, "select * from (values " + ", ".join(f"('{r}', true)" for r in _rows) + ") t(name, ok)")

# ---------------------------------------------------------------- files: what is read again is what was written
for _name, _same in {"scan_csv": "load_customers", "scan_split_files": "scan_split", "prediction_sink": "score_batch",
                     "importance_sink": "lr_importance", "score_saved_state": "score_batch"}.items():
    register(_name, SQL[_same])

# no medians are saved: the median of the whole batch
register("score_missing_medians", with_base(*[x if x is not MED else MED.replace(" where split='train'", "") for x in PREP_ENC], body=f"""
select customerID, premium_no_backup, long_tenure_low_value, {prob_sql('scorecard')} churn_probability from en"""))
