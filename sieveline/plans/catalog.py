"""The named queries: each a Spark plan over the test tables and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from sieveline.functions import kernels as K, pixels as X, stain as Z
from sieveline.operators import dedup as D, metrics as M, ordering as O, quality as Q, routing as R, sampling as S, stats as T
from sieveline.plans import pipelines as P
from sieveline.sources import views as V
from sieveline.sources.readers import batches, by_path, gather, table
from sieveline.schema import finite, ratio, require_columns

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = V.duck(sql)
        return f

    return add


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def expr(name: str, view, columns: list[str], sql: str) -> None:
    """A projection query."""
    query(name, sql)(lambda s, d: view(s, d).selectExpr(*columns))


def _feat(s, d):
    return Q.features(V.patch(s, d))


def _planes(s, d):
    return Q.planes(V.patch(s, d))


# DuckDB's side of the pixel features, over v_patch: sixteen pixels of three values
def _share(condition: str, over: str = "range(16)", n: int = 16) -> str:
    return f"len([k for k in {over} if {condition}])/{n}e0"


def _otsu(values: str, top: str) -> str:
    """Threshold of a list of sixteen values: all splits of the bins in turn."""
    bins = f"[least(cast(floor(x*(256e0/{top})) as int),255) for x in {values}]"
    score = "[case when len([x for x in b if x<t])=0 or len([x for x in b if x<t])=len(b) then -1e0 else len([x for x in b if x<t])::double*len([x for x in b if x>=t])*pow(list_avg([(x+0.5e0) for x in b if x<t])-list_avg([(x+0.5e0) for x in b if x>=t]),2) end for t in range(1,255)]"
    best = f"(select case when list_max(sc)<0 then 0.5e0*{top} else (list_position(sc, list_max(sc))+0.5e0)*({top}/256e0) end from (select {score} as sc from (select {bins} as b)))"
    return best


_TOP, _LOW = "greatest(px[3*k+1],px[3*k+2],px[3*k+3])", "least(px[3*k+1],px[3*k+2],px[3*k+3])"
# how often a window of eleven with repeated edges meets place j of four, from place i
_W = "(case when {j}=0 then 6-{i} when {j}=3 then 3+{i} else 1 end)"
_WW = f"{_W.format(i='(p//4)', j='(q//4)')}*{_W.format(i='(p%4)', j='(q%4)')}"
_AT = "gray[4*greatest(0,least(3,k//4+({y})))+greatest(0,least(3,k%4+({x})))+1]"
_PX = f"v_pix as (select *, [(px[3*k+1]+px[3*k+2]+px[3*k+3])/3e0 for k in range(16)] as gray, [0.299e0*px[3*k+1]+0.587e0*px[3*k+2]+0.114e0*px[3*k+3] for k in range(16)] as luma, [case when {_TOP}>1e-8 then ({_TOP}-{_LOW})/{_TOP} else 0e0 end for k in range(16)] as sat from v_patch ), "
_PX += f"v_box as (select *, [list_sum([{_WW}*gray[q+1] for q in range(16)])/121e0 for p in range(16)] as box1, [list_sum([{_WW}*gray[q+1]*gray[q+1] for q in range(16)])/121e0 for p in range(16)] as box2 from v_pix ), "
_PX += "v_mix as (select *, len([k for k in range(16) if sat[k+1]>0.12e0 or box2[k+1]-box1[k+1]*box1[k+1]>0.003e0])/16e0 as mixed, list_aggregate(gray,'quantile_cont',0.05) as p5, list_aggregate(gray,'quantile_cont',0.95) as p95 from v_box ), "
_PX += "v_flat as (select *, [least(greatest((x-p5)/greatest(p95-p5,1e-8),0e0),1e0) for x in gray] as flat from v_mix ), "
_PX += f"v_cut as (select *, case when mixed between 0.12e0 and 0.45e0 then {_otsu('flat', '1e0')} end as dark_cut from v_flat ), "
_PX += "v_feat as (select *, list_avg([px[3*k+1] for k in range(16)]) as mean_r, list_avg([px[3*k+2] for k in range(16)]) as mean_g, list_avg([px[3*k+3] for k in range(16)]) as mean_b, "
_PX += "list_aggregate([px[3*k+1] for k in range(16)],'stddev_pop') as std_r, list_aggregate([px[3*k+2] for k in range(16)],'stddev_pop') as std_g, list_aggregate([px[3*k+3] for k in range(16)],'stddev_pop') as std_b, "
_PX += "list_avg(gray) as mean_gray, list_aggregate(gray,'stddev_pop') as std_gray, list_avg(luma) as mean_luma, list_aggregate(luma,'stddev_pop') as std_luma, list_aggregate(px,'stddev_pop') as std_px, "
_PX += "list_avg(sat) as sat_mean, len([x for x in sat if x>0.12e0])/16e0 as tissue_proxy, case when dark_cut is null then mixed else greatest(mixed, len([x for x in flat if x<dark_cut])/16e0) end as tissue, len([x for x in gray if x<0.9e0])/16e0 as tissue_gray, "
_PX += "len([x for x in px if x<=0.1e0])/48e0 as black, len([x for x in px if x>=0.9e0])/48e0 as white, len([x for x in px if x<=1/255e0])/48e0 as black_strict, len([x for x in px if x>=254/255e0])/48e0 as white_strict, len([x for x in luma if x<0.05e0])/16e0 as black_luma, "
_PX += f"{_share('px[3*k+3]>px[3*k+1]')} as blue_dom, {_share('px[3*k+1]>px[3*k+3]')} as pink, {_share('px[3*k+1]>0.55e0 and px[3*k+2]>0.35e0 and px[3*k+3]>0.55e0')} as pink_proxy, list_min(px) as min_px, list_max(px) as max_px, "
_PX += f"list_aggregate([{_AT.format(y=-1, x=0)}+{_AT.format(y=1, x=0)}+{_AT.format(y=0, x=-1)}+{_AT.format(y=0, x=1)}-4*gray[k+1] for k in range(16)],'var_pop') as blur from v_cut )"


def _px(sql: str) -> str:
    return f"with v_patch as ({V.DUCK['v_patch']}), {_PX} {sql}"


def pixq(name: str, columns: list[str], sql: str) -> None:
    QUERIES[name] = lambda s, d: _feat(s, d).selectExpr(*columns)
    SQL[name] = _px(sql)


_GATE = "case when std_gray < 0.04e0 then 'solid_color' when black >= 0.5e0 then 'high_black' when tissue < 0.35e0 then 'low_tissue' end"
_W_, _B_ = "min_px>=254/255e0", "max_px<=1/255e0"
_ANOM = f"[x for x in [case when std_px<=1e-6 then 'zero_std' end, case when {_W_} then 'all_white' end, case when {_B_} and not {_W_} then 'all_black' end, case when black_strict>=0.95e0 and not {_W_} and not {_B_} then 'high_black_ratio' end, "
_ANOM += f"case when white_strict>=0.95e0 and not {_W_} and not {_B_} then 'high_white_ratio' end, case when blur<=1e-3 then 'low_blur_score' end, case when std_gray<=0.05e0 then 'low_contrast' end, case when tissue_gray/3e0<0.2e0 then 'low_tissue' end] if x is not null]"

# ------------------------------------------------------------------ sources
query("src_scan_partitioned", "select split, dataset, count(*) as n from v_docs where split in ('train','test') group by split, dataset")(
    lambda s, d: V.docs(s, d).where("split in ('train', 'test')").groupBy("split", "dataset").agg(F.count("*").alias("n"))
)
query("src_schema_check", "select patient || '_' || node as patient_node, count(*) as n from v_meta group by 1")(
    lambda s, d: require_columns(V.meta(s, d), ["patient", "node"]).groupBy(F.concat_ws("_", "patient", "node").alias("patient_node")).agg(F.count("*").alias("n"))
)
query("src_json_field", "select event_id, json_extract_string(props, '$.k') as k from events")(lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")))
query("src_kept_paths", "select idx, 'patches/patient_' || lpad(patient, 6, '0') || '_node_' || substr(node, 1, 1) || '/' || idx || '.png' as path from v_meta")(
    lambda s, d: V.meta(s, d).select("idx", F.concat(F.lit("patches/patient_"), F.lpad("patient", 6, "0"), F.lit("_node_"), F.substring("node", 1, 1), F.lit("/"), F.col("idx"), F.lit(".png")).alias("path"))
)
# ------------------------------------------------------------------ functions


def listq(name: str, spark: str, duck: str, view: str = "planes") -> None:
    """Sum, greatest, and sum by place of a derived array per row."""
    QUERIES[name] = lambda s, d: (_planes(s, d) if view == "planes" else V.patch(s, d)).selectExpr("idx", f"{spark} as v").selectExpr(
        "idx", "round(aggregate(v, 0d, (a, x) -> a + x), 6) as total", "round(cast(array_max(v) as double), 6) as top", "round(aggregate(transform(v, (x, i) -> (i + 1) * cast(x as double)), 0d, (a, x) -> a + x), 5) as placed"
    )
    SQL[name] = _px(f"select idx, round(list_sum(v)::double, 6) as total, round(list_max(v)::double, 6) as top, round(list_sum([i*v[i]::double for i in range(1, len(v)+1)]), 5) as placed from (select idx, {duck} as v from v_feat)")


# every third image on 0..255, the others on 0..1 or a little beyond
_WIDE, _WIDED = "transform(px, x -> x * (case when idx % 3 = 0 then 255d when idx % 3 = 1 then 1d else 1.2d end))", "[x * (case when idx % 3 = 0 then 255e0 when idx % 3 = 1 then 1e0 else 1.2e0 end) for x in px]"


def _wide(expression: str) -> str:
    """expression over the list w."""
    return f"(select {expression} from (select {_WIDED} as w))"


def wideq(name: str, spark: str, duck: str) -> None:
    """As listq, over images of mixed ranges."""
    QUERIES[name] = lambda s, d: V.patch(s, d).selectExpr("idx", f"{_WIDE} as w").selectExpr("idx", f"{spark} as v").selectExpr(
        "idx", "round(aggregate(v, 0d, (a, x) -> a + x), 6) as total", "round(cast(array_max(v) as double), 6) as top", "round(aggregate(transform(v, (x, i) -> (i + 1) * cast(x as double)), 0d, (a, x) -> a + x), 5) as placed"
    )
    SQL[name] = _px(f"select idx, round(list_sum(v)::double, 6) as total, round(list_max(v)::double, 6) as top, round(list_sum([i*v[i]::double for i in range(1, len(v)+1)]), 5) as placed from (select idx, {_wide(duck)} as v from v_patch)")


wideq("fn_to01", X.to_unit("w"), "[least(greatest(case when list_max(w)>1 then x/255e0 else x end,0e0),1e0) for x in w]")
wideq("fn_to01_loose", X.to_unit("w", "1.5d"), "[least(greatest(case when list_max(w)>1.5e0 then x/255e0 else x end,0e0),1e0) for x in w]")
wideq("fn_to_u8_trunc", X.to_u8("w"), "[cast(floor(case when list_max(w)>1 then least(greatest(x,0e0),255e0) else least(greatest(x,0e0),1e0)*255e0 end) as int) for x in w]")
wideq("fn_to_u8_round", X.to_u8_half_even("w"), "[cast(round_even(least(greatest(case when list_max(w)<=1+1e-6 then x*255e0 else x end,0e0),255e0),0) as int) for x in w]")
wideq("fn_to_u8_clip", X.to_u8_clip("w"), "[cast(floor(least(greatest(x,0e0),255e0)) as int) for x in w]")
listq("fn_gray_mean", "gray", "gray")
listq("fn_gray_luma", "luma", "luma")
listq("fn_saturation", "sat", "sat")
listq("fn_saturation_u8", X.saturation("px", "1e-6d"), "[case when greatest(px[3*k+1],px[3*k+2],px[3*k+3])>1e-6 then (greatest(px[3*k+1],px[3*k+2],px[3*k+3])-least(px[3*k+1],px[3*k+2],px[3*k+3]))/greatest(px[3*k+1],px[3*k+2],px[3*k+3]) else 0e0 end for k in range(16)]")
listq("fn_stretch", X.stretch("gray", "0.05d", "0.95d"), "flat")
listq("fn_nucleus_green", "transform(sequence(0,15), k -> 255d - floor(px[3*k+1]*255d))", "[255e0-floor(px[3*k+2]*255e0) for k in range(16)]")
listq("fn_nucleus_blue", "transform(sequence(0,15), k -> floor(px[3*k+2]*255d))", "[floor(px[3*k+3]*255e0) for k in range(16)]")
listq("fn_nucleus_purple", "transform(sequence(0,15), k -> greatest(0d, 2d*floor(px[3*k+2]*255d)-floor(px[3*k]*255d)-floor(px[3*k+1]*255d)))", "[greatest(0e0, 2e0*floor(px[3*k+3]*255e0)-floor(px[3*k+1]*255e0)-floor(px[3*k+2]*255e0)) for k in range(16)]")


def kernelq(name: str, kernel, duck: str, kind: str = "array<double>") -> None:
    """As listq, of a kernel that gives an image."""
    QUERIES[name] = lambda s, d: V.patch(s, d).select("idx", K.image_column(kernel, 4, kind)("px").alias("v")).selectExpr(
        "idx", "round(aggregate(transform(v, x -> cast(x as double)), 0d, (a, x) -> a + x), 6) as total", "round(cast(array_max(v) as double), 6) as top", "round(aggregate(transform(v, (x, i) -> (i + 1) * cast(x as double)), 0d, (a, x) -> a + x), 5) as placed"
    )
    SQL[name] = _px(f"select idx, round(list_sum(v)::double, 6) as total, round(list_max(v)::double, 6) as top, round(list_sum([i*v[i]::double for i in range(1, len(v)+1)]), 5) as placed from (select idx, {duck} as v from v_feat)")


_P2, _P98 = "list_aggregate(px,'quantile_cont',0.02)", "list_aggregate(px,'quantile_cont',0.98)"
kernelq("fn_stretch_u8", K.stretch, f"[cast(floor(case when {_P98}>{_P2} then (least(greatest(x,{_P2}),{_P98})-{_P2})/({_P98}-{_P2})*255e0 else x end) as int) for x in px]", "array<int>")


def featq(name: str, columns: list[str], rest: str = "") -> None:
    """Rounded feature columns."""
    shown = ["idx", *(f"round({c},6) as {c}" for c in columns)]
    pixq(name, shown, f"select {', '.join(shown)} from v_feat")


featq("fn_channel_stats", ["mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b"])
featq("fn_black_white_ratio", ["black", "white", "black_strict", "white_strict", "black_luma"])
featq("fn_color_dominance", ["blue_dom", "pink", "pink_proxy"])
featq("fn_tissue_proxy", ["tissue_proxy"])
featq("fn_tissue_final", ["tissue"])
featq("fn_laplacian_blur", ["blur"])
featq("fn_routing_features", list(R.ROUTING))
featq("fn_mean_saturation", ["sat_mean"])
pixq("fn_per_image_stats", ["idx", "label", *(f"round({c},6) as {n}" for n, c in P.AUDIT.items())], f"select idx, label, {', '.join(f'round({c},6) as {n}' for n, c in P.AUDIT.items())} from v_feat")
pixq("fn_l1_ref", ["idx", "round(abs(mean_r-0.7d)+abs(mean_g-0.5d)+abs(mean_b-0.7d),6) l1"], "select idx, round(abs(mean_r-0.7e0)+abs(mean_g-0.5e0)+abs(mean_b-0.7e0),6) l1 from v_feat")
query("fn_guardrails", _px("select idx, mean_r < 0.08e0 or pink < 0.01e0 or sat_mean < 0.03e0 as fails from v_feat"))(lambda s, d: _feat(s, d).select("idx", Q.guardrail().alias("fails")))
pixq("fn_gray_background_tissue", ["idx", "round(tissue_gray,6) share", "round(tissue_gray/3d,6) legacy_share"], "select idx, round(tissue_gray,6) as share, round(tissue_gray/3e0,6) legacy_share from v_feat")
query("fn_otsu", _px(f"select idx, round({_otsu('gray', '1e0')},9) as otsu from v_feat"))(lambda s, d: V.patch(s, d).select("idx", F.round(K.column(lambda x: K.otsu(x.mean(axis=-1)), 4)("px"), 9).alias("otsu")))
query("fn_otsu_u8", _px(f"select idx, round({_otsu('[255e0-floor(px[3*k+2]*255e0) for k in range(16)]', '256e0')},9) as otsu from v_feat"))(lambda s, d: V.patch(s, d).select("idx", F.round(K.column(lambda x: K.otsu(K.nucleus_channel(x), 256.0), 4)("px"), 9).alias("otsu")))
query("fn_local_variance", _px("select idx, round(list_avg([greatest(box2[k+1]-box1[k+1]*box1[k+1],0e0) for k in range(16)]),9) as variance from v_feat"))(lambda s, d: V.patch(s, d).select("idx", F.round(K.column(lambda x: K.box_variance(x.mean(axis=-1)).mean(axis=(-2, -1)), 4)("px"), 9).alias("variance")))
query("fn_center_label", _px("select idx, round((luma[6]+luma[7]+luma[10]+luma[11])/4e0,6) as frac2, round(list_avg(luma),6) as frac4, cast((luma[6]+luma[7]+luma[10]+luma[11])/4e0 > 0.5e0 as int) as label from v_feat"))(
    lambda s, d: _planes(s, d).select("idx", F.round(X.center("luma", 4, 2), 6).alias("frac2"), F.round(X.center("luma", 4, 4), 6).alias("frac4"), (X.center("luma", 4, 2) > 0.5).cast("int").alias("label"))
)

# CIELAB in SQL, pixel by pixel
_F = "case when {t} > 0.008856e0 then cbrt({t}) else 7.787e0*({t})+16/116e0 end"
_G = "case when {f} > 0.206893e0 then pow({f},3) else ({f}-16/116e0)/7.787e0 end"
_LIN = "case when {c} > 0.04045e0 then pow(({c}+0.055e0)/1.055e0,2.4e0) else {c}/12.92e0 end"
_GAM = "least(greatest(case when {c} > 0.0031308e0 then 1.055e0*pow({c},1/2.4e0)-0.055e0 else 12.92e0*{c} end,0e0),1e0)"


def _matrix(m, names: str, scale=(1, 1, 1)) -> list[str]:
    return ["(" + "+".join(f"({float(v)!r}::double)*{n}" for v, n in zip(row, names, strict=True)) + f")/{float(w)!r}::double" for row, w in zip(m, scale, strict=True)]


def _lab(source: str) -> str:
    """Pixels of source (idx, k, r, g, b) in CIELAB: l, a, bb."""
    x, y, z = _matrix(Z._XYZ, "rgb", Z._WHITE)
    return (
        f"(select idx, k, r0, g0, b0, 116e0*fy-16 as l, 500e0*(fx-fy) as a, 200e0*(fy-fz) as bb from (select idx, k, r0, g0, b0, {_F.format(t='x')} as fx, {_F.format(t='y')} as fy, {_F.format(t='z')} as fz from "
        f"(select idx, k, r0, g0, b0, {x} as x, {y} as y, {z} as z from (select idx, k, r0, g0, b0, {_LIN.format(c='r0')} as r, {_LIN.format(c='g0')} as g, {_LIN.format(c='b0')} as b from ({source})))))"
    )


def _rgb(source: str) -> str:
    """Back from l, a, bb."""

    r, g, b = _matrix(np.linalg.inv(Z._XYZ), "xyz")
    w = [f"{float(v)!r}::double" for v in Z._WHITE]
    return (
        f"(select idx, k, {_GAM.format(c='r')} as r, {_GAM.format(c='g')} as g, {_GAM.format(c='b')} as b from (select idx, k, least(greatest({r},0e0),1e0) as r, least(greatest({g},0e0),1e0) as g, least(greatest({b},0e0),1e0) as b from "
        f"(select idx, k, ({_G.format(f='fx')})*{w[0]} as x, ({_G.format(f='fy')})*{w[1]} as y, ({_G.format(f='fz')})*{w[2]} as z from (select idx, k, (l+16)/116e0+a/500e0 as fx, (l+16)/116e0 as fy, (l+16)/116e0-bb/200e0 as fz from ({source})))))"
    )


_PIXELS = "select idx, k, px[3*k+1] as r0, px[3*k+2] as g0, px[3*k+3] as b0 from v_patch, (select unnest(range(16)) as k)"
_LUM = f"(select p.idx, p.k, case when top > 1e-6 then q.r else r0 end as r, case when top > 1e-6 then q.g else g0 end as g, case when top > 1e-6 then q.b else b0 end as b from (select *, quantile_cont(l,0.95) over (partition by idx) as top from {_lab(_PIXELS)}) p join "
_LUM += _rgb(f"select idx, k, least(greatest(100e0*l/greatest(top,1e-6),0e0),100e0) as l, a, bb from (select *, quantile_cont(l,0.95) over (partition by idx) as top from {_lab(_PIXELS)})") + " q on p.idx = q.idx and p.k = q.k)"
query("fn_luminosity", _px(f"select idx, round(avg(r),6) as r, round(avg(g),6) as g, round(avg(b),6) as b from {_LUM} group by idx"))(
    lambda s, d: V.patch(s, d).select("idx", K.image_column(Z.luminosity, 4)("px").alias("v")).select("idx", *(F.round(F.expr(f"aggregate(transform(sequence(0,15), k -> v[3*k+{c}]), 0d, (a,x) -> a+x)/16d"), 6).alias(n) for c, n in enumerate("rgb")))
)
_STATS = "select idx, avg(l) as ml, avg(a) as ma, avg(bb) as mb, stddev_pop(l) as sl, stddev_pop(a) as sa, stddev_pop(bb) as sb from {lab} group by idx"


def _reinhard(s, d):

    tool = Z.Reinhard(np.array([60.0, 10.0, -5.0]), np.array([12.0, 6.0, 7.0]))
    made = K.image_column(lambda x: np.stack([out if (out := tool.transform(i)) is not None else np.full_like(i, np.nan) for i in x]) if len(x) else x, 4)
    shown = V.patch(s, d).select("idx", made("px").alias("v")).select("idx", *(finite(F.expr(f"aggregate(transform(sequence(0,15), k -> v[3*k+{c}]), 0d, (a,x) -> a+x)/16d")).alias(n) for c, n in enumerate("rgb")))
    return shown.select("idx", *(F.round(n, 5).alias(n) for n in "rgb"))


query("fn_reinhard", _px(
    f"select idx, case when ok then round(avg(r),5) end as r, case when ok then round(avg(g),5) end as g, case when ok then round(avg(b),5) end as b from (select q.*, sl >= 1e-8 and sa >= 1e-8 and sb >= 1e-8 as ok from "
    + _rgb(f"select p.idx, k, (l-ml)/greatest(sl,1e-8)*12e0+60e0 as l, (a-ma)/greatest(sa,1e-8)*6e0+10e0 as a, (bb-mb)/greatest(sb,1e-8)*7e0-5e0 as bb from {_lab(_PIXELS)} p join ({_STATS.format(lab=_lab(_PIXELS))}) t on p.idx = t.idx")
    + f" q join ({_STATS.format(lab=_lab(_PIXELS))}) t on q.idx = t.idx) group by idx, ok"
))(_reinhard)

# gain, bias and saturation from draws by a hash of idx
_DRAW, _DRAWD = "conv(substr(md5(concat('{k}:', cast(idx as string))), 1, 7), 16, 10) / 268435456d", "cast('0x' || substr(md5('{k}:' || idx), 1, 7) as bigint) / 268435456e0"


def _jitter(s, d):

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return K.list_of(K.jitter(K.batch_of(x, 4), np.stack([v.to_numpy(zero_copy_only=False) for v in (a, b, c)], axis=1)))

    rows = V.patch(s, d).select("idx", run("px", *(F.expr(f"cast({_DRAW.format(k=k)} as double)") for k in (1, 2, 3))).alias("v"))
    return rows.selectExpr("idx", "round(aggregate(v, 0d, (a, x) -> a + x), 6) as total", "round(aggregate(transform(v, (x, i) -> (i + 1) * x), 0d, (a, x) -> a + x), 5) as placed")


_JP = "select idx, 3*k+c as i, case c when 0 then r when 1 then g else b end as v, (r+g+b)/3e0 as m, u3 from (select idx, k, u3, " + ", ".join(f"least(greatest(px[3*k+{c}]*(0.9e0+0.2e0*u1)+(0.06e0*u2-0.03e0),0e0),1e0) as {n}" for c, n in ((1, "r"), (2, "g"), (3, "b")))
_JP += f" from (select *, {_DRAWD.format(k=1)} as u1, {_DRAWD.format(k=2)} as u2, {_DRAWD.format(k=3)} as u3 from v_patch), (select unnest(range(16)) as k)), (select unnest(range(3)) as c)"
query("fn_jitter", _px(f"select idx, round(sum(w),6) as total, round(sum((i+1)*w),5) as placed from (select idx, i, least(greatest((v-m)*(0.9e0+0.2e0*u3)+m,0e0),1e0) as w from ({_JP})) group by idx"))(_jitter)
query("fn_resize_bicubic")(lambda s, d: V.patch(s, d).select("idx", K.image_column(lambda x: K.resize(x, 8, 8), 4)("px").alias("v")).selectExpr("idx", "round(aggregate(v, 0d, (a, x) -> a + x), 6) as total"))
query("fn_nucleus_diameters")(lambda s, d: V.patch(s, d).select("idx", K.list_column(lambda x: K.nucleus_diameters(x, least=1), 4)("px").alias("d")).select("idx", F.size("d").alias("n"), F.round(F.try_divide(F.lit(7.0), F.expr("(get(array_sort(d), cast(floor((size(d)-1)/2) as int)) + get(array_sort(d), cast(floor(size(d)/2) as int))) / 2")), 6).alias("scale")))
expr("fn_sigmoid_temp", V.pred, ["idx", "round(p,6) p", "round(1d/(1d+exp(-z/1.978d)),6) p_cal"], "select idx, round(p,6) p, round(1e0/(1e0+exp(-z/1.978e0)),6) p_cal from v_pred")
_Q, _QD = "least(greatest(p,1e-12d),1d-1e-12d)", "least(greatest(p,1e-12),1e0-1e-12)"
expr("fn_confidence_entropy", V.pred, ["idx", "cast(p>=0.5d as int) y_hat", "round(greatest(p,1d-p),6) confidence", f"round(-({_Q}*ln({_Q})+(1d-{_Q})*ln(1d-{_Q})),6) entropy"],
     f"select idx, cast(p>=0.5e0 as int) y_hat, round(greatest(p,1e0-p),6) confidence, round(-({_QD}*ln({_QD})+(1e0-{_QD})*ln(1e0-{_QD})),6) entropy from v_pred")
expr("fn_content_hash", V.docs, ["idx", "h", "md5(text) m"], "select idx, h, md5(text) m from v_docs")
query("fn_quantised_hash", _px("select sha256(array_to_string([cast(floor(x*3e0) as int) for x in px],',')) h, count(*) n from v_feat group by 1"))(
    lambda s, d: V.patch(s, d).groupBy(F.expr("sha2(array_join(transform(px, x -> cast(floor(x*3d) as int)),','),256)").alias("h")).agg(F.count("*").alias("n"))
)
query("fn_id_normalise", "select idx, coalesce(cast(try_cast(trim(' 00'||patient||' ') as bigint) as varchar), trim(patient)) pid, coalesce(cast(try_cast(trim(node) as bigint) as varchar), trim(node)) nid from v_meta")(
    lambda s, d: V.meta(s, d).select("idx", S.normal_id(F.concat(F.lit(" 00"), "patient", F.lit(" "))).alias("pid"), S.normal_id(F.col("node")).alias("nid"))
)
query("fn_split_recode", "select idx, case when center=1 then 'val' when center=2 then 'test' when split_code=0 then 'train' when split_code=1 then 'id_val' when split_code=2 then 'test' when split_code=3 then 'val' end split_name from v_meta")(
    lambda s, d: V.meta(s, d).select("idx", S.split_recode(F.col("split_code"), F.col("center")).alias("split_name"))
)
_POOL = "transform(sequence(0,7), t -> transform(slice(embedding, 8*t+1, 8), x -> cast(x as double)))"  # eight tokens of eight numbers
query("fn_embedding_pool", "select vec_id, len(v) as width, round(list_sum(v),6) as total, round(list_sum([i*v[i] for i in range(1,17)]),5) as placed from (select vec_id, list_concat([embedding[i]::double for i in range(1,9)], [(embedding[40+i]::double+embedding[48+i]::double+embedding[56+i]::double)/3e0 for i in range(1,9)]) as v from embeddings)")(
    lambda s, d: table(s, d, "embeddings").selectExpr("vec_id", f"{_POOL} as t").select("vec_id", X.pooled("t", 5).alias("v")).selectExpr("vec_id", "cast(size(v) as long) as width", "round(aggregate(v,0d,(a,x)->a+x),6) as total", "round(aggregate(transform(v,(x,i)->(i+1)*x),0d,(a,x)->a+x),5) as placed")
)
query("fn_finite", "select idx, case when idx%5 in (0,1,2) then null else round(z,4) end v from v_pred")(
    lambda s, d: V.pred(s, d).select("idx", finite(F.round(F.when(F.col("idx") % 5 == 0, float("nan")).when(F.col("idx") % 5 == 1, float("inf")).when(F.col("idx") % 5 == 2, -float("inf")).otherwise(F.col("z")), 4)).alias("v"))
)
query("fn_compact_metrics", "select event_id, json_extract_string(doc,'$.n') as n, json_extract_string(doc,'$.auc') as auc from (select event_id, '{\"n\": ' || event_id || ', \"auc\": \"' || event_type || '\", \"rest\": [1]}' as doc from events)")(
    lambda s, d: table(s, d, "events").select("event_id", F.concat(F.lit('{"n": '), F.col("event_id"), F.lit(', "auc": "'), F.col("event_type"), F.lit('", "rest": [1]}')).alias("doc")).select("event_id", F.get_json_object("doc", "$.n").alias("n"), F.get_json_object("doc", "$.auc").alias("auc"))
)
_MODEL = [((i * 37) % 11 - 5) / 10 for i in range(64)]


def _scores(s, d):

    @F.arrow_udf("double")
    def logits(x: pa.Array) -> pa.Array:  # a frozen model of one linear layer, batch by batch
        return pa.array(np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), 64) @ np.array(_MODEL) + 0.25)

    return table(s, d, "embeddings").select("vec_id", F.round(logits("embedding"), 6).alias("logit"))


query("ud_model_scores", f"select vec_id, round(list_sum([embedding[i]::double * [{','.join(f'{w}e0' for w in _MODEL)}][i] for i in range(1,65)]) + 0.25e0, 6) as logit from embeddings")(_scores)
# ------------------------------------------------------------------ filters
query("flt_quality_gate", _px(f"select idx, {_GATE} reason from v_feat"))(lambda s, d: _feat(s, d).select("idx", Q.gate().alias("reason")))
query("flt_quality_gate_documented", _px("select idx, case when std_luma < 0.04e0 then 'solid_color' when black_luma >= 0.5e0 then 'high_black' when tissue_proxy < 0.35e0 then 'low_tissue' end reason from v_feat"))(lambda s, d: _feat(s, d).select("idx", Q.gate_documented().alias("reason")))
query("flt_anomaly_flags", _px(f"select idx, array_to_string({_ANOM}, ',') reasons, round(std_px,6) std, round(min_px,4) low, round(max_px,4) high, round(black_strict,4) ratio_black, round(white_strict,4) ratio_white, round(black,4) ratio_black_relaxed, round(white,4) ratio_white_relaxed, round(std_gray,6) gray_std, round(blur,6) blur_score, round(tissue_gray/3e0,4) tissue_pct from v_feat where len({_ANOM})>0"))(
    lambda s, d: _feat(s, d).withColumn("a", Q.anomalies()).where("size(a) > 0").selectExpr("idx", "array_join(a, ',') reasons", "round(std_px,6) std", "round(min_px,4) low", "round(max_px,4) high", "round(black_strict,4) ratio_black", "round(white_strict,4) ratio_white", "round(black,4) ratio_black_relaxed", "round(white,4) ratio_white_relaxed", "round(std_gray,6) gray_std", "round(blur,6) blur_score", "round(tissue_gray/3d,4) tissue_pct")
)
query("flt_reason_overlap", _px(f"select idx from v_feat where list_has_any({_ANOM}, ['low_tissue','high_black_ratio'])"))(
    lambda s, d: _feat(s, d).where(F.arrays_overlap(Q.anomalies(), F.array(F.lit("low_tissue"), F.lit("high_black_ratio")))).select("idx")
)
query("flt_candidates", _px("select idx from v_feat where std_gray >= 0.04e0 and black < 0.5e0 and tissue >= 0.5e0"))(lambda s, d: _feat(s, d).where(Q.candidate()).select("idx"))
query("flt_low_blur", _px("select idx from v_feat where blur <= (select quantile_cont(blur,0.02) from v_feat)"))(lambda s, d: _feat(s, d).crossJoin(F.broadcast(O.percentiles(_feat(s, d), "blur", [0.02], names=["cut"]))).where("blur <= cut").select("idx"))
query("flt_percentile_tail", _px("select idx, split from (select *, quantile_cont(mean_r,0.02) over (partition by split) a, quantile_cont(pink,0.02) over (partition by split) b from v_feat) where mean_r<=a or pink<=b"))(
    lambda s, d: Q.tail(_feat(s, d), ["mean_r", "pink"], 0.02).where("in_tail").select("idx", "split")
)
_BUCKETS = f"v_h as (select *, cast(p>=0.5e0 as int) y_hat, greatest(p,1e0-p) confidence, -({_QD}*ln({_QD})+(1e0-{_QD})*ln(1e0-{_QD})) entropy from v_pred ), v_t as (select *, (select quantile_cont(entropy,0.9) from v_h) tau from v_h ), "
_BUCKETS += "v_b as (select *, unnest([x for x in [case when y_hat<>y and y_hat=1 then 'FP' end, case when y_hat<>y and y_hat=0 then 'FN' end, case when y_hat<>y and entropy>=tau then 'high_entropy_error' end, case when y_hat=y and entropy>=tau then 'high_entropy_correct' end, case when y_hat<>y and confidence>=0.9e0 then 'confident_error' end] if x is not null]) bucket from v_t )"


def _b(sql: str) -> str:
    return f"with v_pred as ({V.DUCK['v_pred']}), {_BUCKETS} {sql}"


query("flt_error_buckets", _b("select idx, bucket from v_b"))(lambda s, d: S.error_buckets(V.pred_bits(s, d)).select("idx", "bucket"))
# ------------------------------------------------------------------ joins
_A, _B = "select h from v_docs where dataset='A'", "select h from v_docs where dataset='B'"
query("jn_overlap_semi", f"select split, count(*) n, count(*) filter (where h in ({_A})) n_overlap from v_docs where dataset='B' group by split")(
    lambda s, d: V.docs(s, d).where("dataset='B'").join(V.docs(s, d).where("dataset='A'").select("h", F.lit(1).alias("hit")).distinct(), "h", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("hit").alias("n_overlap"))
)
query("jn_overlap_report", " union all ".join(f"select '{a}_vs_{b}' direction, split, count(*) n_samples, count(*) filter (where h in (select h from v_docs where dataset='{b}')) n_overlap, round((count(*) filter (where h in (select h from v_docs where dataset='{b}')))::double/count(*),6) overlap_rate from v_docs where dataset='{a}' group by split" for a, b in ("AB", "BA")))(
    lambda s, d: D.overlap_report({x: V.docs(s, d).where(f"dataset='{x}'") for x in "AB"})
)
_QH = "sha256(array_to_string([cast(floor(x*1e0) as int) for x in px],','))"
_SO = "select *, row_number() over (partition by dataset order by md5('42:'||idx), idx) rn from (select *, " + _QH + " as h from v_feat)"
query("jn_sampled_overlap", _px(f"select n, overlap, tissue_n, tissue_overlap, round(overlap::double/n,6) rate, round(tissue_overlap::double/greatest(tissue_n,1),6) tissue_rate from (with s as materialized (select * from ({_SO}) where rn<=300) select count(*) n, count(*) filter (where h in (select h from s where dataset=0)) overlap, count(*) filter (where tissue>=0.35e0) tissue_n, count(*) filter (where tissue>=0.35e0 and h in (select h from s where dataset=0 and tissue>=0.35e0)) tissue_overlap from s where dataset=1)"))(
    lambda s, d: D.sampled_overlap(*(_feat(s, d).where(f"dataset={k}").select("idx", "tissue", F.expr("sha2(array_join(transform(px, x -> cast(floor(x*1d) as int)),','),256)").alias("h")) for k in (0, 1)), n=300)
)
query("jn_semi_candidates", "select idx, split from v_docs where idx in (select doc_id from labels where quality=1)")(lambda s, d: gather(V.docs(s, d), table(s, d, "labels").where("quality=1").withColumnRenamed("doc_id", "idx")).select("idx", "split"))
query("jn_left_lookup", "select idx, coalesce(quality,-1) quality, coalesce(toxic,-1) toxic from v_docs left join labels on doc_id=idx")(
    lambda s, d: V.docs(s, d).join(table(s, d, "labels"), F.col("idx") == F.col("doc_id"), "left").select("idx", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))
)
query("jn_by_path", "select m.idx, n as bytes from (select idx, 'patches/'||patient||'/'||idx||'.png' as path from v_meta) m join (select 'root/patches/'||o_custkey||'/'||o_orderkey||'.png' as file, o_orderkey%97 as n from orders) f on file = 'root/'||path")(
    lambda s, d: by_path(V.meta(s, d).select("idx", F.concat(F.lit("patches/"), "patient", F.lit("/"), "idx", F.lit(".png")).alias("path")), table(s, d, "orders").select(F.concat(F.lit("root/patches/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".png")).alias("path"), (F.col("o_orderkey") % 97).alias("bytes"))).select("idx", "bytes")
)
query("jn_conditions", "select * from (values ('C1','A','A','inside'),('C2','A','B','outside'),('C3','B','B','inside'),('C4','B','A','outside')) t(condition,trained,tested,direction)")(lambda s, d: P.condition_table(s, {"A": "runs/a", "B": "runs/b"}).select("condition", "trained", "tested", "direction"))
query("jn_decontaminate_anti", f"select idx, split from v_docs where dataset='B' and h not in ({_A})")(lambda s, d: D.decontaminate(V.docs(s, d).where("dataset='B'"), V.docs(s, d).where("dataset='A'")).select("idx", "split"))
query("jn_positional", "select d.doc_id idx, l.quality, l.toxic from documents d join labels l using (doc_id)")(lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id").selectExpr("doc_id as idx", "quality", "toxic"))
query("jn_paired_counts", "select a.n n_x, b.n n_y, least(a.n,b.n) n from (select count(*) n from documents) a, (select count(*) n from labels) b")(lambda s, d: P.paired_count(table(s, d, "documents"), table(s, d, "labels")))
query("jn_kept_map", "select split, row_number() over (partition by split order by idx)-1 pos, idx from (select split, h, min(idx) idx from v_docs group by split, h)")(lambda s, d: D.positions(D.keep_first(V.docs(s, d))).select("split", "pos", "idx"))
_REFS = "(values (0, 0.7e0, 0.5e0, 0.7e0), (1, 0.4e0, 0.5e0, 0.5e0), (2, 0.5e0, 0.6e0, 0.4e0))"


def _nearest(s, d, power: int):
    refs = [(0, 0.7, 0.5, 0.7), (1, 0.4, 0.5, 0.5), (2, 0.5, 0.6, 0.4)]  # three fixed references: an array in the row, no join
    dist = [F.struct(F.round(sum((F.abs(F.col(c) - x) if power == 1 else (F.col(c) - x) * (F.col(c) - x) for c, x in zip(("mean_r", "mean_g", "mean_b"), r[1:])), F.lit(0.0)), 9).alias("d"), F.lit(r[0]).alias("j")) for r in refs]
    return _feat(s, d).select("idx", F.array_min(F.array(*dist))["j"].alias("ref"))


query("jn_nearest_ref", _px(f"select idx, arg_min(j, (round(abs(mean_r-r)+abs(mean_g-g)+abs(mean_b-b),9), j)) as ref from v_feat, {_REFS} t(j,r,g,b) group by idx"))(lambda s, d: _nearest(s, d, 1))
_CENTRES = [[0.5 * (((c * 5 + j * 3) % 7) - 3) for j in range(7)] for c in range(4)]
_MEANS, _STDS = [0.6, 0.45, 0.5, 0.5, 0.5, 0.45, 0.3], [0.3, 0.2, 0.2, 0.2, 0.3, 0.3, 0.2]


def _router():

    return R.Router(np.array(_MEANS), np.array(_STDS), np.array(_CENTRES), 3, {0: 1, 1: 2, 2: 0})


_GAPS = [f"round({'+'.join(f'pow(({n}-{m}e0)/{v}e0-({z}e0),2)' for n, m, v, z in zip(R.ROUTING, _MEANS, _STDS, c))},9)" for c in _CENTRES]
_CLUSTER = f"list_position([{','.join(_GAPS)}], list_min([{','.join(_GAPS)}]))-1"
query("jn_kmeans_assign", _px(f"select idx, {_CLUSTER} as cluster from v_feat"))(lambda s, d: _feat(s, d).select("idx", _router().cluster().alias("cluster")))
query("jn_router_pack", _px(f"select idx, case c when 0 then 1 when 1 then 2 when 2 then 0 else arg_min(j, (round(abs(mean_r-r)+abs(mean_g-g)+abs(mean_b-b),9), j)) end as pack from (select *, {_CLUSTER} as c from v_feat), {_REFS} t(j,r,g,b) group by idx, c"))(
    lambda s, d: _feat(s, d).select("idx", _router().pack([(0.7, 0.5, 0.7), (0.4, 0.5, 0.5), (0.5, 0.6, 0.4)]).alias("pack"))
)


@query("jn_assignment_3x3", "with c as (select n_nationkey%3 i, n_regionkey%3 j, avg(n_nationkey*7%11)::double cost from nation group by 1,2), g as (select x.i, y.j, coalesce(c.cost,9e0) as cost from (select unnest(range(3)) as i) x cross join (select unnest(range(3)) as j) y left join c on c.i=x.i and c.j=y.j) "
       "select a.j a, b.j b, c.j c, round(a.cost+b.cost+c.cost,6) total from g a, g b, g c where a.i=0 and b.i=1 and c.i=2 and a.j<>b.j and b.j<>c.j and a.j<>c.j order by total, a.j, b.j limit 1")  # fmt: skip
def _assign(s, d):
    cost = table(s, d, "nation").groupBy((F.col("n_nationkey") % 3).alias("i"), (F.col("n_regionkey") % 3).alias("j")).agg(F.avg((F.col("n_nationkey") * 7 % 11).cast("double")).alias("cost"))
    # nine cells become one map; the six permutations are enumerated in the row
    cells = cost.agg(F.map_from_entries(F.collect_list(F.struct(F.col("i") * 3 + F.col("j"), "cost"))).alias("m"))
    total = [F.struct(F.round(sum((F.coalesce(F.col("m")[i * 3 + j], F.lit(9.0)) for i, j in enumerate(p)), F.lit(0.0)), 6).alias("total"), *(F.lit(j).cast("long").alias(n) for n, j in zip("abc", p))) for p in [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]]
    return cells.select(F.array_min(F.array(*total)).alias("t")).select("t.a", "t.b", "t.c", "t.total")


query("jn_paired_runs", "select a.idx, round(abs(a.p-1e0/(1e0+exp(-a.z/2e0))),6) delta from v_pred a join v_pred b using (idx)")(
    lambda s, d: V.pred(s, d).select("idx", "p").join(V.pred(s, d).selectExpr("idx", "1d/(1d+exp(-z/2d)) as q"), "idx").select("idx", F.round(F.abs(F.col("p") - F.col("q")), 6).alias("delta"))
)
_HOLD = "select patient_id from (select patient_id, row_number() over (order by md5('42:'||patient_id)) rn, count(*) over () g from (select distinct patient_id from v_meta)) where rn <= greatest(1, round_even(g*0.1e0,0))"
query("jn_group_membership", f"select idx, patient_id in ({_HOLD}) holdout from v_meta")(lambda s, d: S.group_holdout(V.meta(s, d), "patient_id", 0.1).select("idx", "holdout"))
query("jn_bbox_range", "select count(*) n, sum(r.r_regionkey) total from events e, region r where not (e.value+5 < r.r_regionkey*100 or e.value > r.r_regionkey*100+20)")(
    lambda s, d: table(s, d, "events").join(F.broadcast(table(s, d, "region")), F.expr("not (value + 5 < r_regionkey * 100 or value > r_regionkey * 100 + 20)")).agg(F.count("*").alias("n"), F.sum("r_regionkey").alias("total"))
)
_XB, _XE = "e.value as x0, e.value+30 as x1, (e.event_id%400)*1e0 as y0, (e.event_id%400)+30e0 as y1", "not (p1x < x0 or p1y < y0 or p0x > x1 or p0y > y1)"
query("jn_bbox_2d", f"select event_id, s_suppkey from (select event_id, {_XB} from events e) , (select s_suppkey, (s_suppkey*37%500)*1e0 p0x, (s_suppkey*37%500)+12e0 p1x, (s_suppkey*53%400)*1e0 p0y, (s_suppkey*53%400)+9e0 p1y from supplier where s_suppkey<=20) where {_XE}")(
    lambda s, d: table(s, d, "events").alias("e").selectExpr("event_id", "e.value as x0", "e.value+30 as x1", "(e.event_id%400)*1d as y0", "(e.event_id%400)+30d as y1").join(F.broadcast(table(s, d, "supplier").where("s_suppkey<=20").selectExpr("s_suppkey", "(s_suppkey*37%500)*1d p0x", "(s_suppkey*37%500)+12d p1x", "(s_suppkey*53%400)*1d p0y", "(s_suppkey*53%400)+9d p1y")), F.expr(_XE)).select("event_id", "s_suppkey")
)
query("jn_pivot_transfer_lower", "with m as (select arm, test, avg((p-y)*(p-y)) b from v_pred group by 1,2), w as (select arm, max(b) filter (where test=0) a, max(b) filter (where test=1) b from m group by arm) select arm, round(a,6) inside, round(b,6) outside, round(b-a,6) drop_abs, round((b-a)/(abs(a)+1e-8),6) drop_rel from w".replace("with m", f"with v_pred as ({V.DUCK['v_pred']}), m", 1))(
    lambda s, d: M.transfer(V.pred(s, d).groupBy("arm", "test").agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("b")), "arm", "test", "b", 0, 1, lower_is_better=True)
)
query("jn_pivot_transfer", "select * from (with m as (select arm, test, avg(cast((p>=0.5e0)=(y=1) as int))::double acc from v_pred group by 1,2), w as (select arm, max(acc) filter (where test=0) a, max(acc) filter (where test=1) b from m group by arm) select arm, round(a,6) inside, round(b,6) outside, round(a-b,6) drop_abs, round((a-b)/(abs(a)+1e-8),6) drop_rel from w)")(
    lambda s, d: M.transfer(V.pred(s, d).groupBy("arm", "test").agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("acc")), "arm", "test", "acc", 0, 1)
)
# ------------------------------------------------------------------ aggregates
query("ag_dup_groups", "select split, h, count(*) n, min(idx) first_idx, max(idx) last_idx, sum(idx)::bigint sum_idx from v_docs group by split, h having count(*)>1")(lambda s, d: D.duplicate_groups(V.docs(s, d)))
query("ag_dedup_manifest", "select split, sum(n)::bigint n_original, count(*) n_kept, (sum(n)-count(*))::bigint n_removed, count(*) filter (where n>1) n_groups from (select split, h, count(*) n from v_docs group by split, h) group by split")(lambda s, d: D.manifest(V.docs(s, d)))
query("ag_hash_counts_sets", "select coalesce(split,'all') split, count(distinct h) n_unique from v_docs group by grouping sets ((split),())")(
    lambda s, d: V.docs(s, d).groupingSets([["split"], []], "split").agg(F.count_distinct("h").alias("n_unique")).select(F.coalesce("split", F.lit("all")).alias("split"), "n_unique")
)
query("ag_label_stats", "select split, sum(n)::bigint n_samples, (sum(n) filter (where y>0.5))::bigint n_positive, (sum(n) filter (where y<=0.5))::bigint n_negative, round((sum(n) filter (where y>0.5))::double/sum(n),6) frac_positive, string_agg(y||'='||n, ',' order by y) label_values from (select split, y, count(*) n from v_pred group by 1,2) group by split")(
    lambda s, d: P.label_stats(V.pred(s, d), label="y").withColumn("label_values", F.array_join(F.transform(F.array_sort(F.map_entries("label_value_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")).drop("label_value_counts")
)
query("ag_reason_counts", _px(f"select split, coalesce({_GATE},'keep') reason, count(*) n from v_feat group by 1,2"))(lambda s, d: _feat(s, d).groupBy("split", F.coalesce(Q.gate(), F.lit("keep")).alias("reason")).agg(F.count("*").alias("n")))
query("ag_describe", _px(" union all ".join(f"select split, '{n}' metric, round(avg({c}),6) mean, round(stddev_pop({c}),6) std, round(min({c}),6) low, round(max({c}),6) high from v_feat group by split" for n, c in P.AUDIT.items())))(lambda s, d: P.described(P.per_image(V.patch(s, d), 4)))
_QM = {"blur": 1e-3, "std_gray": 0.05, "mean_r": None, "mean_g": None, "mean_b": None, "std_r": None, "std_g": None, "std_b": None}
query("ag_quality_moments", _px(" union all ".join(f"select split, '{m}' measure, round(avg({m}),6) mean, round(sqrt(greatest(avg({m}*{m})-avg({m})*avg({m}),0)),6) std, round(min({m}),6) low, round(max({m}),6) high, {f'{c}::double' if c else 'null::double'} low_threshold, count(*) filter (where {m}<={c or 'null'}) low_count from v_feat group by split" for m, c in _QM.items())))(lambda s, d: P.quality_moments(_feat(s, d)))
query("ag_moments", "select event_type, round(avg(value),6) mean, round(sqrt(greatest(avg(value*value)-avg(value)*avg(value),0)),4) std, min(value) low, max(value) high from events group by event_type")(
    lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sqrt(F.greatest(F.expr("avg(value*value)-avg(value)*avg(value)"), F.lit(0.0))), 4).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
)
query("ag_array_moments", _px("select k pos, round(avg(px[k+1]),6) mean, round(stddev_pop(px[k+1]),6) std from v_feat, (select unnest(range(48)) k) group by k"))(
    lambda s, d: V.patch(s, d).select(F.posexplode("px").alias("pos", "v")).groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))
)
query("ag_percentiles", _px("select split, round(quantile_cont(blue_dom,0.25),6) p25, round(quantile_cont(blue_dom,0.02),6) p2, round(quantile_cont(blue_dom,0.9),6) p90 from v_feat group by split"))(
    lambda s, d: O.percentiles(_feat(s, d), "blue_dom", [0.25, 0.02, 0.9], ["split"]).select("split", *(F.round(c, 6).alias(c) for c in ("p25", "p2", "p90")))
)
query("ag_sampled_threshold", _px("select split, round(quantile_cont(blue_dom,0.25),6) threshold from (select *, row_number() over (partition by split order by md5('42:'||idx), idx) rn from v_feat) where rn<=60 group by split"))(lambda s, d: R.thresholds(_feat(s, d), n=60).select("split", F.round("threshold", 6).alias("threshold")))
_NAMES = "(values (0,'macenko'),(1,'reinhard'),(2,'macenko_fallback'),(3,'reinhard_fallback'),(4,'luminosity_only')) c(code,name)"
_ROUTE = "select *, quantile_cont(blue_dom,0.25) over (partition by split) cut, quantile_cont(mean_r,0.02) over (partition by split) a, quantile_cont(pink,0.02) over (partition by split) b from v_feat"


def _coded(s, d):
    """Codes by rule alone: the tail and the guardrail fall back, else the threshold decides."""
    rows = Q.tail(_feat(s, d), ["mean_r", "pink"], 0.02)
    cut = O.percentiles(_feat(s, d), "blue_dom", [0.25], ["split"], ["cut"])
    return rows.join(cut, "split").withColumn("code", F.when(F.col("in_tail") | Q.guardrail(), 4).when(F.col("blue_dom") < F.col("cut"), 1).otherwise(0))


query("ag_normalizer_usage", _px(f"select s.split, c.code, c.name, coalesce(n,0) n, round(coalesce(n,0)::double/total,6) rate from (select split, count(*) total from v_feat group by split) s cross join {_NAMES} left join (select split, code, count(*) n from (select split, case when mean_r<=a or pink<=b or mean_r<0.08e0 or pink<0.01e0 or sat_mean<0.03e0 then 4 when blue_dom<cut then 1 else 0 end code from ({_ROUTE})) group by split, code) k on k.split=s.split and k.code=c.code"))(
    lambda s, d: R.usage(_coded(s, d))
)
_CONF = "select split, count(*) filter (where p>=0.5e0 and y=1) tp, count(*) filter (where p>=0.5e0 and y=0) fp, count(*) filter (where p<0.5e0 and y=1) fn, count(*) filter (where p<0.5e0 and y=0) tn from v_pred group by split"
query("ag_confusion", _CONF)(lambda s, d: M.confusion(V.pred(s, d), ["split"]))
query("ag_class_metrics", f"select split, round((tp+tn)::double/(tp+fp+fn+tn),6) accuracy, round(tp::double/(tp+fp),6) as precision, round(tp::double/(tp+fn),6) recall, round(tn::double/(tn+fp),6) specificity, round(2e0*tp/(2*tp+fp+fn),6) f1, round((tp::double/(tp+fn)+tn::double/(tn+fp))/2,6) balanced_accuracy from ({_CONF})")(
    lambda s, d: M.class_metrics(V.pred(s, d), ["split"])
)
for _n, _v in (("", "v_pred"), ("_big", "v_pred_big")):
    _view = V.pred if not _n else V.pred_big
    query(f"ag_roc_auc{_n}", f"select round((sum(r) filter (where y=1) - count(*) filter (where y=1)*(count(*) filter (where y=1)+1)/2e0)/(count(*) filter (where y=1)*1e0*count(*) filter (where y=0)),6) roc_auc from (select y, rank() over (order by p)+(count(*) over (partition by p)-1)/2e0 r from {_v} )")(
        lambda s, d, v=_view: M.roc_auc(v(s, d))
    )
    query(f"ag_avg_precision{_n}", f"select round(sum(tp*ctp/cn)/sum(tp),6) average_precision from (select tp, sum(tp) over (order by p desc) ctp, sum(n) over (order by p desc) cn from (select p, sum(y)::double tp, count(*)::double n from {_v} group by p))")(
        lambda s, d, v=_view: M.average_precision(v(s, d))
    )
    query(f"ag_ece{_n}", f"select round(sum(n*abs(conf-acc))/sum(n),6) ece from (select least(cast(floor(p*15) as int),14) b, count(*) n, avg(p) conf, avg(y) acc from {_v} group by 1)")(lambda s, d, v=_view: M.ece(v(s, d)))
    _L = "least(greatest(1e0/(1e0+exp(-z/t)),1e-7),1e0-1e-7)"
    query(f"ag_temperature{_n}", f"select round(arg_min(t,(nll,i)),6) temperature, round(min(nll),6) nll from (select i, t, round(avg(-ln(case when y=1 then {_L} else 1e0-{_L} end)),9) nll from {_v} , (select i, 0.2e0*pow(25e0,i/59e0) t from (select unnest(range(60)) i)) group by i, t)")(
        lambda s, d, v=_view: M.fit_temperature(v(s, d))
    )
_P7 = "least(greatest(p,1e-7),1e0-1e-7)"
query("ag_raw_loss", "select split, round(avg(-ln(case when y=1 then q else 1e0-q end)),6) raw_nll from (select *, least(greatest(1e0/(1e0+exp(-z)),1e-7),1e0-1e-7) q from v_pred ) group by split")(lambda s, d: M.raw_loss(V.pred(s, d), ["split"]))
query("ag_temperature_80", "select round(arg_min(t,(nll,i)),6) temperature, round(min(nll),6) nll from (select i, t, round(avg(-ln(case when y=1 then " + _L + " else 1e0-" + _L + " end)),9) nll from v_pred , (select i, 0.2e0*pow(25e0,i/79e0) t from (select unnest(range(80)) i)) group by i, t)")(lambda s, d: M.fit_temperature(V.pred(s, d), grid=80))
query("ag_mcc", f"select split, round(case when den=0 then 0 else (tp::double*tn-fp::double*fn)/den end,6) mcc from (select *, sqrt((tp+fp)::double*(tp+fn)*(tn+fp)*(tn+fn)) den from ({_CONF}))")(lambda s, d: M.matthews(V.pred(s, d), ["split"]))
query("ag_brier_logloss", f"select split, round(avg(({_P7}-y)*({_P7}-y)),6) brier, round(avg(-(y*ln({_P7})+(1-y)*ln(1e0-{_P7}))),6) log_loss from v_pred group by split")(lambda s, d: M.brier_logloss(V.pred(s, d), ["split"]))
query("ag_ece_bins", "select b.i::int bin, coalesce(n,0) n, round(conf,6) conf, round(acc,6) acc from (select unnest(range(15)) i) b left join (select least(cast(floor(p*15) as int),14) b, count(*) n, avg(p) conf, avg(y) acc from v_pred group by 1) x on x.b=b.i")(lambda s, d: M.all_bins(V.pred(s, d)))
query("ag_mc_dropout", "select idx, round(avg(q),6) m, round(stddev_pop(q),6) sd from (select idx, 1e0/(1e0+exp(-(z+(idx*(k+1)%7-3)*0.1e0))) q from v_pred , (select unnest(range(5)) k)) group by idx")(
    lambda s, d: V.pred(s, d).select("idx", F.expr("explode(transform(sequence(0,4), k -> 1d/(1d+exp(-(z+(idx*(k+1)%7-3)*0.1d))))) as q")).groupBy("idx").agg(F.round(F.avg("q"), 6).alias("m"), F.round(F.stddev_pop("q"), 6).alias("sd"))
)
query("ag_mc_summary", "select round(avg(m),6) mean_m, round(stddev_pop(m),6) std_m, round(avg(sd),6) mean_sd, round(stddev_pop(sd),6) std_sd from (select idx, avg(q) m, stddev_pop(q) sd from (select idx, 1e0/(1e0+exp(-(z+(idx*(k+1)%7-3)*0.1e0))) q from v_pred , (select unnest(range(5)) k)) group by idx)")(
    lambda s, d: M.pass_summary(V.pred(s, d).select("idx", F.expr("explode(transform(sequence(0,4), k -> 1d/(1d+exp(-(z+(idx*(k+1)%7-3)*0.1d))))) as q")))[1].select(*(F.round(c, 6).alias(c) for c in ("mean_m", "std_m", "mean_sd", "std_sd")))
)
query("ag_rollup", "select coalesce(dataset,'all') dataset, coalesce(split,'all') split, count(*) n from v_docs group by rollup(dataset, split)")(
    lambda s, d: V.docs(s, d).rollup("dataset", "split").agg(F.count("*").alias("n")).select(F.coalesce("dataset", F.lit("all")).alias("dataset"), F.coalesce("split", F.lit("all")).alias("split"), "n")
)
query("ag_pivot_labels", "select split, count(*) filter (where y=0) neg, count(*) filter (where y=1) pos, count(*) total, round(100e0*count(*) filter (where y=1)/count(*),1) pct_positive from v_pred group by split")(
    lambda s, d: V.pred(s, d).groupBy("split").pivot("y", [0, 1]).count().selectExpr("split", "`0` as neg", "`1` as pos", "`0`+`1` as total", "round(100d*`1`/(`0`+`1`),1) as pct_positive")
)
query("ag_imbalance", "select split, round((count(*) filter (where y=0))::double/count(*) filter (where y=1),4) imbalance from v_pred group by split")(
    lambda s, d: V.pred(s, d).groupBy("split").agg(F.when(F.sum("y") == 0, float("inf")).otherwise(F.round(F.try_divide((F.count("*") - F.sum("y")).cast("double"), F.sum("y").cast("double")), 4)).alias("imbalance"))
)
query("ag_sample_dup_rate", "select count(*) n, count(distinct h) n_unique, round((count(*)-count(distinct h))::double/count(*),6) dup_fraction from (select h from v_docs order by md5('42:'||idx), idx limit 400)")(
    lambda s, d: S.sample(V.docs(s, d).select("idx", "h"), 400).agg(F.count("*").alias("n"), F.count_distinct("h").alias("n_unique")).withColumn("dup_fraction", F.round(ratio(F.col("n") - F.col("n_unique"), F.col("n")), 6))
)
query("ag_balance_drift", _px(f"select split, round(b,6) before, round(a,6) as after, round(abs(a-b),6) drift, abs(a-b)>0.03e0 alert from (select split, avg(label) b, avg(label) filter (where {_GATE} is null) a from v_feat group by split)"))(lambda s, d: Q.balance(_feat(s, d)))
query("ag_stain_effect", _px("select count(*) n, round(avg(abs(mean_r-0.7e0)+abs(mean_g-0.5e0)+abs(mean_b-0.7e0)),6) l1, round(avg(pink),6) pink, round(stddev_pop(mean_r),6) std_r, count(*) filter (where mean_r<0.2e0 or mean_r>0.8e0 or mean_b<0.2e0 or mean_b>0.8e0) outliers, count(*) filter (where mean_r<0.2e0 or pink<0.05e0) purple from v_feat"))(
    lambda s, d: _feat(s, d).selectExpr("count(*) n", "round(avg(abs(mean_r-0.7d)+abs(mean_g-0.5d)+abs(mean_b-0.7d)),6) l1", "round(avg(pink),6) pink", "round(stddev_pop(mean_r),6) std_r", "count_if(mean_r<0.2d or mean_r>0.8d or mean_b<0.2d or mean_b>0.8d) outliers", "count_if(mean_r<0.2d or pink<0.05d) purple")
)
_RUNS = "select idx, mean_r, mean_g, mean_b, least(greatest(mean_r*0.9e0+0.02e0,0e0),1e0) as nr, mean_g*1.05e0 as ng, mean_b-0.01e0 as nb, pink, min_px, max_px from v_feat"


def _changed(s, d):
    return _feat(s, d).withColumns({"mean_r": F.expr("least(greatest(mean_r*0.9d+0.02d,0d),1d)"), "mean_g": F.expr("mean_g*1.05d"), "mean_b": F.expr("mean_b-0.01d")})


_RD = lambda r, a: f"abs({a[0]}-{r[0]}e0)+abs({a[1]}-{r[1]}e0)+abs({a[2]}-{r[2]}e0)"
_O3, _N3 = ("mean_r", "mean_g", "mean_b"), ("nr", "ng", "nb")
query("ag_run_comparison", _px(f"select count(*) n, round(avg({_RD((0.7, 0.5, 0.7), _O3)}),6) old_to_old, round(avg({_RD((0.4, 0.5, 0.5), _O3)}),6) old_to_new, round(stddev_pop(mean_r),6) old_std_r, round(stddev_pop(mean_g),6) old_std_g, round(stddev_pop(mean_b),6) old_std_b, round(avg({_RD((0.7, 0.5, 0.7), _N3)}),6) new_to_old, round(avg({_RD((0.4, 0.5, 0.5), _N3)}),6) new_to_new, round(stddev_pop(nr),6) new_std_r, round(stddev_pop(ng),6) new_std_g, round(stddev_pop(nb),6) new_std_b, round(avg(abs(mean_r-nr)+abs(mean_g-ng)+abs(mean_b-nb)),6) paired from (select * from ({_RUNS}) order by md5('42:'||idx), idx limit 300)"))(
    lambda s, d: R.compared(_feat(s, d), _changed(s, d), {"old": (0.7, 0.5, 0.7), "new": (0.4, 0.5, 0.5)}, 300)
)
query("ag_stain_before_after", _px(f"select count(*) n, round(avg({_RD((0.7, 0.5, 0.7), _O3)}),6) distance_before, round(avg({_RD((0.7, 0.5, 0.7), _N3)}),6) distance_after, round(avg(({_RD((0.7, 0.5, 0.7), _N3)})-({_RD((0.7, 0.5, 0.7), _O3)})),6) delta, round(avg(mean_r),6) red_before, round(avg(nr),6) red_after, round(avg(pink),6) pink_before, round(avg(pink),6) pink_after, round(stddev_pop(nr),6) std_r, round(stddev_pop(ng),6) std_g, round(stddev_pop(nb),6) std_b, count(*) filter (where nr<0.2e0 or nr>0.8e0 or nb<0.2e0 or nb>0.8e0) outliers, count(*) filter (where nr<0.2e0 or pink<0.05e0) purple, round(avg(min_px),6) low, round(avg(max_px),6) high from (select * from ({_RUNS}) order by md5('42:'||idx), idx limit 300)"))(
    lambda s, d: R.effect(_feat(s, d), _changed(s, d), (0.7, 0.5, 0.7), 300)
)
query("ag_reference", _px("select idx, d from (select idx, round((tissue-mt)*(tissue-mt)+1.5e0*(mean_r-mr)*(mean_r-mr)+(mean_g-mg)*(mean_g-mg)+1.5e0*(mean_b-mb)*(mean_b-mb),9) d from (select *, median(tissue) over () mt, median(mean_r) over () mr, median(mean_g) over () mg, median(mean_b) over () mb from (select * from v_feat order by md5('42:'||idx), idx limit 300) where std_gray>=0.04e0 and black<0.5e0 and tissue>=0.5e0)) order by d, idx limit 1"))(lambda s, d: R.reference(_feat(s, d), 300))
query("ag_reference_documented", _px("select idx, d from (select idx, round((tissue-mt)*(tissue-mt)+1.5e0*(mean_r-mr)*(mean_r-mr)+(mean_g-mg)*(mean_g-mg)+1.5e0*(mean_b-mb)*(mean_b-mb),9) d from (select *, quantile_cont(tissue,0.62) over () mt, quantile_cont(mean_r,0.62) over () mr, quantile_cont(mean_g,0.38) over () mg, quantile_cont(mean_b,0.62) over () mb from (select * from v_feat order by md5('42:'||idx), idx limit 300) where std_gray>=0.04e0 and black<0.5e0 and tissue>=0.5e0)) order by d, idx limit 1"))(lambda s, d: R.reference(_feat(s, d), 300, shares=(0.62, 0.62, 0.38, 0.62)))
query("ag_value_counts", "select split_name, count(*) n from (select case when idx%7=0 then null when center=1 then 'val' when center=2 then 'test' when split_code=0 then 'train' when split_code=1 then 'id_val' when split_code=2 then 'test' else 'val' end split_name from v_meta) group by 1")(
    lambda s, d: V.meta(s, d).select(F.when(F.col("idx") % 7 != 0, S.split_recode(F.col("split_code"), F.col("center"))).alias("split_name")).groupBy("split_name").agg(F.count("*").alias("n"))
)
query("ag_table_summary", " union all ".join(f"select '{c}' as name, count(*) n, count(*)-count({c}) nulls, count(distinct {c}) n_unique, {'round(avg(' + c + '),4)' if k else 'null::double'} mean, {'min(' + c + ')::double' if k else 'null::double'} low, {'max(' + c + ')::double' if k else 'null::double'} high from events" for c, k in (("event_id", 1), ("user_id", 1), ("event_type", 0), ("value", 1))))(
    lambda s, d: T.described(table(s, d, "events").select("event_id", "user_id", "event_type", "value"))
)
query("ag_bucket_summary", _b("select bucket, count(*) available_n, least(count(*),600) sampled_n, greatest(0,600-count(*)) shortfall from v_b group by bucket"))(
    lambda s, d: S.error_buckets(V.pred_bits(s, d)).groupBy("bucket").agg(F.count("*").alias("available_n"), F.least(F.count("*"), F.lit(600).cast("long")).alias("sampled_n"), F.greatest(F.lit(0).cast("long"), 600 - F.count("*")).alias("shortfall"))
)
query("ag_median", _px("select split, round(median(mean_r),6) r from v_feat group by split"))(lambda s, d: O.percentiles(_feat(s, d), "mean_r", [0.5], ["split"], ["r"]).select("split", F.round("r", 6).alias("r")))
_EP = "select user_id%5 as arm, event_id%20 epoch, round(avg(value),6) metric from events group by 1,2"
query("ag_best_epoch", f"select arm, arg_max(epoch,(metric,-epoch)) epoch, max(metric) metric from ({_EP}) group by arm")(
    lambda s, d: table(s, d, "events").groupBy((F.col("user_id") % 5).alias("arm"), (F.col("event_id") % 20).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric")).groupBy("arm").agg(F.max_by("epoch", F.struct("metric", -F.col("epoch"))).alias("epoch"), F.max("metric").alias("metric"))
)
query("ag_histogram", _px("select least(cast(floor(g*256) as int),255) bin, count(*) n from (select unnest(gray) g from v_feat) group by 1"))(lambda s, d: _planes(s, d).select(F.explode("gray").alias("g")).groupBy(F.least(F.floor(F.col("g") * 256).cast("int"), F.lit(255)).alias("bin")).agg(F.count("*").alias("n")))
query("ag_integrity", "select split, sum(o)::bigint n_original, sum(k)::bigint n_kept, max(k)<=1 unique_ok, sum(k)=count(*) and min(o-k)>=0 count_ok from (select split, h, count(*) o, count(*) filter (where idx=first) k from (select *, min(idx) over (partition by split, h) first from v_docs) group by split, h) group by split")(lambda s, d: D.integrity(V.docs(s, d), D.keep_first(V.docs(s, d))))
query("ag_integrity_broken", "select split, sum(o)::bigint n_original, sum(k)::bigint n_kept, max(k)<=1 unique_ok, sum(k)=count(*) and min(o-k)>=0 count_ok from (select split, h, count(*) o, count(*) filter (where idx%3>0) k from v_docs group by split, h) group by split")(lambda s, d: D.integrity(V.docs(s, d), V.docs(s, d).where("idx % 3 > 0")))
query("ag_status", "select split, case when done=n then 'DONE' when done>0 then 'partial' else 'not started' end status from (select split, count(*) n, count(l.doc_id) done from v_docs left join labels l on l.doc_id=idx group by split)")(
    lambda s, d: V.docs(s, d).join(table(s, d, "labels"), F.col("idx") == F.col("doc_id"), "left").groupBy("split").agg(F.count("*").alias("n"), F.count("doc_id").alias("done")).select("split", F.when(F.col("done") == F.col("n"), "DONE").when(F.col("done") > 0, "partial").otherwise("not started").alias("status"))
)
_U = "((a*((r*1103515245::bigint)%2147483647)+b)%2147483647)/2147483647e0"
_ROWS = "select *, cast('0x'||substr(md5('42a:'||idx),1,7) as bigint) a, cast('0x'||substr(md5('42b:'||idx),1,7) as bigint) b from ({0})"
_POIS = " ".join(f"when u<{float(c)!r}::double then {k}" for k, c in enumerate(T._POISSON))
_BOOT = "select round(any_value(e),6) estimate, round(quantile_cont(m,0.025),6) as lower, round(quantile_cont(m,0.975),6) as upper from (select r, any_value(e) e, sum(x*w)/sum(w) m from (select r, x, e, case " + _POIS + " else 8 end w from (select r, x, e, " + _U + " u from (" + _ROWS + "), (select unnest(range(1,2001)) r))) group by r)"
query("ag_bootstrap", V.duck(_BOOT.format("select idx, p x, avg(p) over () e from v_pred ")))(lambda s, d: T.bootstrap(V.pred(s, d), "p").select(*(F.round(c, 6).alias(c) for c in ("estimate", "lower", "upper"))))
query("ag_paired_drop", V.duck(_BOOT.format("select idx, p-1e0/(1e0+exp(-z/2e0)) x, avg(p-1e0/(1e0+exp(-z/2e0))) over () e from v_pred ")))(
    lambda s, d: T.paired_drop(V.pred(s, d).withColumn("q", F.expr("1d/(1d+exp(-z/2d))")), "p", "q").select(*(F.round(c, 6).alias(c) for c in ("estimate", "lower", "upper")))
)
query("ag_permutation", V.duck("select round(any_value(e),6) mean_d, round((count(*) filter (where abs(t)>=s-1e-12)+1)::double/(count(*)+1),6) p_value from (select r, any_value(e) e, any_value(s) s, sum(case when u<0.5e0 then -x else x end) t from (select r, x, e, s, " + _U + " u from (" + _ROWS.format("select idx, p-1e0/(1e0+exp(-z/2e0)) x, avg(p-1e0/(1e0+exp(-z/2e0))) over () e, abs(sum(p-1e0/(1e0+exp(-z/2e0))) over ()) s from v_pred ") + "), (select unnest(range(1,10001)) r)) group by r)"))(
    lambda s, d: T.sign_flip(V.pred(s, d).withColumn("d", F.expr("p - 1d/(1d+exp(-z/2d))")), "d").select(F.round("mean_d", 6).alias("mean_d"), F.round("p_value", 6).alias("p_value"))
)
query("ag_kmeans")(lambda s, d: _feat(s, d).select("idx", _fitted(s, d).cluster().alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n")))


def _fitted(s, d):

    few = _feat(s, d).where("idx in (1, 2, 3, 4)").orderBy("idx").select(*R.ROUTING).collect()
    rows = np.array([list(r) for r in few])
    return R.fit_router(_feat(s, d), rows[0], rows[1:])


_BH = "select event_type, user_id%4 arm, round(exp(-abs(avg(value)-50)),9) p_value from events group by 1,2"
query("ag_bh", f"select event_type, arm, round(least(1e0, min(a) over (order by p_value desc)),6) p_adjusted from (select *, p_value*count(*) over ()/rank() over (order by p_value) a from ({_BH}))")(
    lambda s, d: T.benjamini_hochberg(table(s, d, "events").groupBy("event_type", (F.col("user_id") % 4).alias("arm")).agg(F.round(F.exp(-F.abs(F.avg("value") - 50)), 9).alias("p_value"))).select("event_type", "arm", F.round("p_adjusted", 6).alias("p_adjusted"))
)


@query("ag_wilson", "select split, k, n, round((p+3.8416e0/(2*n)-1.96e0*sqrt(p*(1-p)/n+3.8416e0/(4*n*n)))/(1+3.8416e0/n),6) lower, round((p+3.8416e0/(2*n)+1.96e0*sqrt(p*(1-p)/n+3.8416e0/(4*n*n)))/(1+3.8416e0/n),6) as upper from (select split, sum(y)::bigint k, count(*) n, sum(y)::double/count(*) p from v_pred group by split)")
def _wilson(s, d):
    df = V.pred(s, d).groupBy("split").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    low, high = T.wilson(F.col("k"), F.col("n"))
    return df.select("split", "k", "n", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


# ------------------------------------------------------------------ windows, samples, sets
query("wn_keep_first", "select split, min(idx) idx from v_docs group by split, h")(lambda s, d: D.keep_first(V.docs(s, d)).select("split", "idx"))
query("wn_avg_rank", "select idx, rank() over (partition by split order by p)+(count(*) over (partition by split, p)-1)/2e0 r from v_pred")(lambda s, d: M.average_rank(V.pred(s, d), ["split"]).select("idx", "r"))
query("wn_cumulative", "select p, ctp, cn, round(ctp::double/total,9) recall, round(tp::double/total,9) step from (select p, tp, sum(tp) over (order by p desc)::bigint ctp, sum(n) over (order by p desc)::bigint cn, sum(tp) over () total from (select round(p,9) p, sum(y) tp, count(*) n from v_pred group by 1))")(
    lambda s, d: M.cumulative(V.pred(s, d).select("y", F.round("p", 9).alias("p"))).select("p", F.col("c_tp").cast("long").alias("ctp"), F.col("c_n").cast("long").alias("cn"), F.round("recall", 9).alias("recall"), F.round("step", 9).alias("step"))
)
_CASE = "select idx, bucket, row_number() over (partition by bucket order by md5('42:'||idx), idx) rn from v_b"
query("wn_bucket_ordinal", _b(f"select idx, bucket, format('{{}}_{{:03d}}', bucket, rn-1) case_id, row_number() over (order by bucket, rn) review_order from ({_CASE}) where rn<=50"))(
    lambda s, d: S.per_group(S.error_buckets(V.pred_bits(s, d)), ["bucket"], 50).select("idx", "bucket", F.format_string("%s_%03d", "bucket", F.col("rn") - 1).alias("case_id"), F.row_number().over(Window.orderBy("bucket", "rn")).cast("long").alias("review_order"))
)


def _epw():
    return Window.partitionBy("arm").orderBy("epoch")



def _epochs(s, d):
    return table(s, d, "events").groupBy((F.col("user_id") % 5).alias("arm"), (F.col("event_id") % 20).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))


query("wn_running_best", f"select arm, epoch, metric > coalesce(max(metric) over (partition by arm order by epoch rows between unbounded preceding and 1 preceding), -1e0) improved from ({_EP})")(
    lambda s, d: _epochs(s, d).select("arm", "epoch", (F.col("metric") > F.coalesce(F.max("metric").over(_epw().rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))).alias("improved"))
)
query("wn_running_mean", f"select arm, epoch, round(avg(metric) over (partition by arm order by epoch rows unbounded preceding),5) m from ({_EP})")(lambda s, d: _epochs(s, d).select("arm", "epoch", F.round(F.avg("metric").over(_epw().rowsBetween(Window.unboundedPreceding, 0)), 5).alias("m")))
query("wn_milestones", "select split, idx, mark from (select *, lag(mark,1,0) over (partition by split order by idx) was from (select split, idx, floor(10e0*row_number() over (partition by split order by idx)/count(*) over (partition by split))::bigint mark from v_docs)) where mark>was")(
    lambda s, d: O.milestones(V.docs(s, d).select("split", "idx"), ["idx"], ["split"]).select("split", "idx", "mark")
)
query("wn_regroup", "select conv_id, turn, role, row_number() over (order by role, conv_id, turn, md5(text)) ord from conversations")(
    lambda s, d: O.numbered(table(s, d, "conversations").withColumn("m", F.md5("text")), ["role", "conv_id", "turn", "m"], "ord").select("conv_id", "turn", "role", (F.col("ord") + 1).alias("ord"))
)
query("wn_positions", "select p, rn-1 as pos from (select p, row_number() over (order by p, event_id) rn from (select event_id, p from (select event_id, round(value,2) p from events)))")(
    lambda s, d: O.numbered(table(s, d, "events").select("event_id", F.round("value", 2).alias("p")), ["p", "event_id"], "pos").select("p", "pos")
)
query("wn_batches", "select idx, case when rn-1 < greatest(1, c//64)*64 then (rn-1)//64 end as batch from (select idx, row_number() over (order by md5('42:'||idx), idx) rn, count(*) over () c from v_docs)")(lambda s, d: batches(V.docs(s, d).select("idx"), 64).select("idx", "batch"))
query("st_seeded_sample", "select idx from v_docs order by md5('7:'||idx), idx limit 100")(lambda s, d: S.sample(V.docs(s, d).select("idx"), 100, 7))
query("st_topk", "select idx, round(abs(p-y),6) delta from v_pred order by round(abs(p-y),6) desc, idx limit 48")(lambda s, d: V.pred(s, d).select("idx", F.round(F.abs(F.col("p") - F.col("y")), 6).alias("delta")).orderBy(F.desc("delta"), "idx").limit(48))
query("st_seed_offsets", " union all ".join(f"select * from (select '{t}' split, idx from v_docs where split='{t}' order by md5('{42 + i * 10007 + 123}:'||idx), idx limit 20)" for i, t in enumerate(("train", "valid", "test"))))(
    lambda s, d: _union([S.sample(V.docs(s, d).where(f"split='{t}'").select("split", "idx"), 20, S.stratum_seed(42, 1, i)) for i, t in enumerate(("train", "valid", "test"))])
)
query("st_sharpest_of_tail", _px("select idx, round(blur,9) blur from v_feat where blur <= (select quantile_cont(blur,0.1) from v_feat) order by blur desc, idx limit 24"))(lambda s, d: S.extremes(_feat(s, d).select("idx", "blur"), "blur", 0.1, 24).select("idx", F.round("blur", 9).alias("blur")))
query("st_sharpest", _px("select idx, round(blur,9) blur from v_feat order by blur desc, idx limit 24"))(lambda s, d: S.extremes(_feat(s, d).select("idx", "blur"), "blur", 1.0, 24, least=False).select("idx", F.round("blur", 9).alias("blur")))
query("st_low_tail", _px("select idx from v_feat order by round(blue_dom,9), idx limit 2"))(lambda s, d: _feat(s, d).select("idx", F.round("blue_dom", 9).alias("b")).orderBy("b", "idx").limit(2).select("idx"))
query("st_threshold_slice", "select idx, p from (select idx, round(p,6) p from v_pred ) where p>0.9e0 order by p desc, idx limit 60")(lambda s, d: S.above(V.pred(s, d).select("idx", F.round("p", 6).alias("p")), "p", 0.9, 60))
query("st_first_matches", "select idx from (select * from v_pred order by idx limit 200) where y=1 order by idx limit 12")(lambda s, d: S.first_matches(V.pred(s, d).select("idx", "y"), F.col("y") == 1).select("idx"))
query("st_head", "select idx from v_docs order by idx limit 15")(lambda s, d: V.docs(s, d).select("idx").orderBy("idx").limit(15))
query("st_class_sample", "select idx, y from (select *, row_number() over (partition by y order by md5('42:'||idx), idx) rn from v_pred ) where rn<=4")(lambda s, d: S.per_group(V.pred(s, d), ["y"], 4).select("idx", "y"))
query("st_bucket_preview", _b("select bucket, idx from (select *, row_number() over (partition by bucket order by idx) rn from v_b ) where rn<=6"))(
    lambda s, d: S.error_buckets(V.pred_bits(s, d)).withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("idx"))).where("rn <= 6").select("bucket", "idx")
)
query("st_assigned_splits", f"select idx, case when valid then 'valid' when patient_id in (select patient_id from (select patient_id, row_number() over (order by md5('42:'||patient_id)) rn, count(*) over () g from (select distinct patient_id from v_meta where split_code<>1)) where rn <= greatest(1, round_even(g*0.1e0,0))) then 'test' else 'train' end split from (select *, split_code=1 valid from v_meta)")(
    lambda s, d: S.assigned_splits(V.meta(s, d), "patient_id", valid=F.col("split_code") == 1).select("idx", "split")
)
query("st_official_splits", "select idx, case when n='id_val' then 'valid' else n end split from (select idx, case when center=1 then 'val' when center=2 then 'test' when split_code=0 then 'train' when split_code=1 then 'id_val' when split_code=2 then 'test' else 'val' end n from v_meta) where n in ('train','id_val','test')")(
    lambda s, d: S.official_splits(V.meta(s, d).withColumn("split", F.col("split_code"))).select("idx", "split")
)
query("st_argmin", _px("select split, arg_min(idx,(round(mean_r,6),idx)) idx from v_feat group by split"))(lambda s, d: _feat(s, d).groupBy("split").agg(F.min_by("idx", F.struct(F.round("mean_r", 6), "idx")).alias("idx")))
query("st_balanced", "with v as (select idx, y, row_number() over (partition by y order by md5('42:'||idx), idx) rn from V_), t as (select count(*) taken from v where y=1 and rn<=100) select idx, y from v, t where (y=1 and rn<=100) or (y=0 and rn<=200-taken)".replace("V_", f"({V.DUCK['v_pred']})"))(
    lambda s, d: S.balanced(V.pred(s, d), 200, "y").select("idx", "y")
)
query("st_bucket_sample", _b(f"select idx, bucket from ({_CASE}) where rn<=10"))(lambda s, d: S.per_group(S.error_buckets(V.pred_bits(s, d)), ["bucket"], 10).select("idx", "bucket"))
query("st_group_holdout", f"select holdout, count(*) n, count(distinct patient_id) g from (select patient_id, patient_id in ({_HOLD}) holdout from v_meta) group by holdout")(
    lambda s, d: S.group_holdout(V.meta(s, d), "patient_id", 0.1).groupBy("holdout").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("g"))
)
query("so_union_intersect", f"select (select count(*) from ({_A} union {_B})) n_union, (select count(*) from ({_A} intersect {_B})) n_intersect")(
    lambda s, d: V.docs(s, d).groupBy("h").agg(F.count_distinct("dataset").alias("k")).agg(F.count("*").alias("n_union"), F.count_if(F.col("k") == 2).alias("n_intersect"))
)
query("so_except", f"select distinct h from v_docs where dataset='A' except {_B}")(lambda s, d: V.docs(s, d).where("dataset='A'").select("h").subtract(V.docs(s, d).where("dataset='B'").select("h")))
query("so_bag_union", "select 'A' src, split, count(*) n from v_docs where dataset='A' group by split union all select 'B', split, count(*) from v_docs where dataset='B' group by split")(
    lambda s, d: V.docs(s, d).where("dataset='A'").withColumn("src", F.lit("A")).unionByName(V.docs(s, d).where("dataset='B'").withColumn("src", F.lit("B"))).groupBy("src", "split").agg(F.count("*").alias("n"))
)
# ------------------------------------------------------------------ composites
_HASH = "sha256(array_to_string([cast(floor(least(greatest(x,0e0),1e0)*255e0) as int) for x in px],','))"
query("pl_cleaned", _px(f"select idx, split from (select *, min(idx) over (partition by split, {_HASH}) first from v_feat) where idx=first and len({_ANOM})=0"))(lambda s, d: P.cleaned(V.patch(s, d), 4).select("idx", "split"))
_REPORT = f"select split, count(*) n_samples, count(*) filter (where label>=0.5) positive, count(*) filter (where label<0.5) negative, count(*) filter (where len({_ANOM})>0) n_anomalous, count(*) filter (where list_has_any({_ANOM}, ['zero_std','all_white','all_black','high_white_ratio','high_black_ratio'])) n_blank_like, round((count(*) filter (where label<0.5))::double/count(*) filter (where label>=0.5),4) imbalance from v_feat group by split"
query("pl_quality_report", _px(_REPORT))(lambda s, d: P.quality_report(V.patch(s, d), 4).select("split", "n_samples", "positive", "negative", "n_anomalous", "n_blank_like", "imbalance"))
query("pl_report_rows", _px(f"select split, 'anomalies' as section, f as name, count(*)::double as value from (select split, unnest({_ANOM}) f from v_feat) group by split, f"))(lambda s, d: P.flattened(P.quality_report(V.patch(s, d), 4)).where("section = 'anomalies'"))
_AUD = " union all ".join(
    f"select {k} dataset, '{t}' split, count(*) n_samples, count(*) filter (where label>0.5) n_positive, count(*) filter (where label<=0.5) n_negative, round(avg((label>0.5)::int),6) frac_positive, any_value(r) sampled_mean_r, any_value(g) sampled_mean_g, any_value(b) sampled_mean_b, any_value(ti) sampled_tissue_proxy_mean, any_value(bl) sampled_black_ratio_mean, any_value(bd) sampled_blue_dom_mean, any_value(du) sampled_duplicate_fraction from v_feat, "
    f"(select round(avg(mean_r),6) r, round(avg(mean_g),6) g, round(avg(mean_b),6) b, round(avg(tissue_proxy),6) ti, round(avg(black_luma),6) bl, round(avg(blue_dom),6) bd, round((count(*)-count(distinct {_HASH}))::double/count(*),6) du from (select * from v_feat where dataset={k} and split='{t}' order by md5('{42 + j * 10007 + k * 123}:'||idx), idx limit 40)) where dataset={k} and split='{t}'"
    for k in (0, 1) for j, t in enumerate(("train", "valid", "test"))
)
query("pl_audit", _px(f"select * replace (dataset::varchar as dataset) from ({_AUD}) where n_samples>0"))(lambda s, d: P.audit({str(k): V.patch(s, d).where(f"dataset={k}") for k in (0, 1)}, 4, 40))
query("pl_review_order", _b(f"select idx, bucket, format('{{}}_{{:03d}}', bucket, rn-1) case_id, row_number() over (order by bucket, rn) review_order from ({_CASE}) where rn<=20"))(lambda s, d: P.review(V.pred_bits(s, d), 20).select("idx", "bucket", "case_id", F.col("review_order").cast("long").alias("review_order")))


def _processed(s, d):

    ref = np.array(V.patch(s, d).where("idx = 6").first()["px"]).reshape(4, 4, 3)
    return P.process(V.patch(s, d), [Z.Pack.fit(ref)], 4)


query("pl_process_report")(lambda s, d: _processed(s, d)[1])
query("pl_process_rows")(lambda s, d: _processed(s, d)[0].select("split", "idx", "code", "in_tail"))
