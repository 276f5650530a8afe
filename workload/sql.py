"""DuckDB twins of the registered queries, over the same derived tables."""

from spectralake.sources import catalogue

# Written out here, so that a wrong constant of the engine shows.
SCALE = 1000.0
LIGHT_SPEED, PLANCK = 299792458.0, 6.62607015e-34
UNITS = {"counts": "counts", "wm": "W/(m2 nm)", "wmsr": "W/(m2 sr nm)", "phmsr": "Nph./(m2 sr)"}

DATE = "01/01/2025 00:00"


def R(expr, digits=4):
    """Rounded value without a negative zero."""
    return f"(round({expr}, {digits}) + 0e0)"


# name -> (views it reads, body)
VIEWS = {}


def view(name, needs, body):
    VIEWS[name] = (needs.split(), body.strip())


def query(needs, body):
    """Body with the views it needs in front, each once, in dependency order."""
    order, seen = [], set()

    def add(name):
        if name in seen:
            return
        seen.add(name)
        for n in VIEWS[name][0]:
            add(n)
        order.append(name)

    for n in needs.split():
        add(n)
    ctes = ",\n".join(f"{n} as materialized ({VIEWS[n][1]})" for n in order)
    return (f"with recursive {ctes}\n" if ctes else "") + body.strip()


def values(rows):
    def cell(c):
        if c is None:
            return "null"
        if isinstance(c, bool):
            return str(c).lower()
        if isinstance(c, float):
            return f"{c!r}::double"
        return f"'{c}'" if isinstance(c, str) else f"{c}::bigint"
    return "values " + ", ".join("(" + ", ".join(cell(c) for c in row) + ")" for row in rows)


# --- derived tables -----------------------------------------------------------

view("frames", "", """
select vec_id // 250 as shot, (vec_id % 250) // 25 as frame, vec_id % 25 as y, (vec_id // 250) % 10 as cal_id,
       cast(x - 1 as bigint) as x, cast(round((cast(embedding[x] as double) + 1) * 1000) as bigint) as counts
from embeddings, range(1, 65) t(x)""")
view("stacks", "frames", """
select shot, cal_id, max(frame) + 1 as n_frames, 0.1e0 * (shot + 1) as exposure_s, 0.25e0 as cycle_s,
       2.75e0 as trig_delay_s, 1 + shot % 2 as xbin, 2::bigint as ybin, 64::bigint as dim_w, 25::bigint as dim_o
from frames group by shot, cal_id""")
view("shots", "", """
select 100000 + o_orderkey as shot, o_orderdate, o_orderstatus,
       'data/' || (o_orderkey % 7) || '/' || (100000 + o_orderkey) || '_image.SIF' as path,
       1 + o_orderkey % 50 as n_frames, 0.1e0 * (1 + o_orderkey % 9) as exposure_s,
       0.25e0 as cycle_s, 2.75e0 as trig_delay_s, 1 + o_orderkey % 2 as xbin, 1 + o_orderkey % 3 as ybin,
       (case when o_orderkey % 5 = 4 then 2048 else 1024 end)::bigint as dim_w,
       (case when o_orderkey % 11 = 10 then 100 when o_orderkey % 5 = 4 then 2048 else 1024 end)::bigint as dim_o
from orders""")
view("pattern", "", """
select s_suppkey as cal_id, o.ord, x.x, 3 + 6 * o.ord + x.x // 24 + s_suppkey % 2 as yc
from supplier, range(0, 4) o(ord), range(0, 64) x(x)""")
view("line_list", "", """
select cal_id, ord, px, round(700e0 - 20e0 * ord - 0.4e0 * px - 0.0005e0 * px * px + 0.001e0 * wobble, 4) as wl
from (select l_suppkey as cal_id, (l_linenumber::bigint - 1) % 4 as ord,
             ((l_orderkey * 3 + l_partkey) % 64)::double as px, l_quantity % 3 - 1 as wobble from lineitem)""")
view("lamp_lines", "", """
select cal_id, ord, px, round(700e0 - 20e0 * ord - 0.4e0 * px - 0.0005e0 * px * px + 0.01e0 * wobble, 4) as wl
from (select l_orderkey as cal_id, l_linenumber::bigint % 2 as ord,
             9e0 * l_linenumber + l_partkey % 7 + 0.25e0 as px, (l_suppkey % 5)::double as wobble from lineitem)""")
view("images", "", """
select s_suppkey as cal_id, y.y, x.x, 1000 - ((x.x - 32) * (x.x - 32)) // 2 + y.y + s_suppkey % 5 as sphere,
       50 + (x.x + y.y + s_suppkey) % 3 as dark
from supplier, range(0, 25) y(y), range(0, 64) x(x)""")
view("knots", "", """
select s_suppkey as cal_id, (300 + 84 * i) / 1000e0 as um,
       (i + 1)::double * (i + 1)::double * (30 - i)::double / 20 + s_suppkey % 7 as mw
from supplier, range(0, 26) t(i)""")
view("exposures", "", "select s_suppkey as cal_id, 0.5e0 + 0.25e0 * (s_nationkey % 3) as exposure_s from supplier")
view("small_bands", "", "select * from (" + values([
    ("b692", "H", 690.0, 694.0), ("b684", "H", 682.0, 686.0), ("b668", "He", 666.0, 670.0),
    ("b650", "C", 648.0, 652.0), ("b630", "C", 628.0, 632.0)]) + ") b(band, grp, lo, hi)")
view("small_lines", "", "select * from (" + values([
    ("b692", 0, 692.0, 1.0, "2s-3s", "1/2-3/2"), ("b684", 0, 683.5, 2.0, "2s-3p", "*-*"),
    ("b684", 1, 684.6, 1.0, "2s-3p", "0-1"), ("b668", 0, 667.4, 1.0, "2s-3d", "1-2"),
    ("b668", 1, 668.2, 1.5, "2s-3d", "1-3"), ("b668", 2, 668.9, 0.5, "2s-3d", "1-1"),
    ("b650", 0, 650.0, 3.0, "2p-4d", "*-*"), ("b630", 0, 630.2, 1.0, "2p-4s", "1-0")])
    + ") t(band, line, wl, ak, config, j)")
view("atomic", "", """
select 'B' || (p_partkey // 4) || '-' || (['ECONOMY', 'SMALL', 'LARGE'])[p_partkey // 4 % 3 + 1] as band, p_partkey as line, 400e0 + (p_partkey * 37 % 4001) / 9.97e0 as wl,
       '1s2.2p-1s2.' || (p_partkey % 7 + 2) || substr('spdfghik', cast(p_partkey // 3 % 8 + 1 as int), 1) as config,
       '1/2-' || (['1/2', '3/2', '5/2', '1 1/2', '2', '0', '*', '3'])[p_partkey % 8 + 1] as j,
       p_size::double * 1e6 + p_partkey * 1.7123457e0 as ak, 20e0 + p_partkey % 100 / 8e0 as e_low, 22e0 + p_partkey % 100 / 4.03e0 as e_high
from part""")
view("measured", "", """
select l_suppkey as shot, l_linenumber::bigint as frame,
       400e0 + ((l_orderkey * 7 + l_partkey * 13 + l_linenumber) % 40001) / 100e0 as wl,
       l_orderkey as seq, l_quantity::bigint as counts
from lineitem""")
view("event_spectra", "", """
select event_id // 1000 as shot, (event_id % 1000) // 10 as frame, 0::bigint as ord, event_id % 10 as x,
       cast(round(value * 100) as bigint) as counts from events""")
view("event_values", "", """
select event_id // 100 as shot, event_id % 100 as frame, event_type as band, value as intensity from events""")
view("event_shots", "", """
select event_id // 100 as shot, 100::bigint as n_frames, 0.25e0 as cycle_s, 2.75e0 as trig_delay_s, 0.5e0 as exposure_s
from events group by 1""")
view("order_peaks", "", """
select l_suppkey as shot, 0::bigint as frame, l_linenumber::bigint - 1 as ord, x,
       case when l_partkey % 10 <> 9
            then 3 + 6e0 * (l_linenumber - 1) + 0.05e0 * x + 0.001e0 * x * x + (l_quantity % 3) / 2 end as y
from (select *, (l_orderkey * 3 + l_partkey) % 64 as x from lineitem)""")

_seen = {}
_lines = []
for _b, _wl, _c, _j, _t, _ak, _lo, _hi in catalogue.LINES:
    _seen[_b] = _seen.get(_b, -1) + 1
    _lines.append((_b, _seen[_b], float(_wl)))
view("cat_lines", "", "select * from (" + values(_lines) + ") t(band, line, wl)")
view("cat_over", "", "select * from (" + values(
    [(b, float(lo), float(hi)) for b, lo, hi in catalogue.BOUNDS]) + ") t(band, lo, hi)")
view("cat_centre", "", "select * from (" + values(
    [(b, float(c)) for b, c in catalogue.CENTRES]) + ") t(band, centre)")
view("cat_groups", "", "select * from (" + values(
    [(g, b, i, g in catalogue.FITTED_GROUPS) for g, bs in catalogue.GROUPS.items() for i, b in enumerate(bs)])
    + ") t(grp, band, pos, fit)")
view("cat_bounds", "cat_lines cat_over cat_centre", """
select coalesce(l.band, o.band) as band, coalesce(o.lo, c.centre - 0.5e0, l.mean - 0.3e0) as lo,
       coalesce(o.hi, c.centre + 0.5e0, l.mean + 0.3e0) as hi
from (select band, avg(wl) as mean from cat_lines group by 1) l
full join cat_over o on l.band = o.band left join cat_centre c on c.band = l.band""")


def fit(name, source, keys, x, y, origin, degree=None):
    """Views ``name``: polynomial fit per group, from covariances of u and u squared."""
    view(f"{name}_s", source, f"""
    select {keys}, count(*) as n, avg(u) as mu, avg(u * u) as mq, avg(v) as mv, var_pop(u) as suu, var_pop(u * u) as sqq,
           covar_pop(u, u * u) as suq, covar_pop(u, v) as suv, covar_pop(u * u, v) as sqv
    from (select {keys}, ({x} - {origin}e0) / {SCALE!r}::double as u, {y} as v from {source}
          where {x} is not null and {y} is not null) group by all""")
    line = "n < 3" if degree is None else "false"
    view(name, f"{name}_s", f"""
    select *, mv - c1 * mu - c2 * mq as c0 from (
      select *, case when {line} then 1 else 2 end as degree,
        case when {line} then case when suu > 0 then suv / suu end
             when suu * sqq - suq * suq > 1e-12 * suu * sqq
             then (suv * sqq - sqv * suq) / (suu * sqq - suq * suq) end as c1,
        case when {line} then case when suu > 0 then 0e0 end
             when suu * sqq - suq * suq > 1e-12 * suu * sqq
             then (sqv * suu - suv * suq) / (suu * sqq - suq * suq) end as c2
      from {name}_s)""")


def poly(x, origin=32):
    u = f"(({x} - {origin}e0) / {SCALE!r}::double)"
    return f"(c0 + {u} * (c1 + {u} * c2))"


fit("lamp_fit", "lamp_lines", "cal_id, ord", "px", "wl", 32)
fit("wl_fit", "line_list", "cal_id, ord", "px", "wl", 32)
fit("curve", "order_peaks", "shot, frame, ord", "x", "y", 32, degree=2)

# --- order masks and spectra ------------------------------------------------------

view("off", "pattern", "select cal_id, ord, min(x) as off from pattern where yc + 2 > 24 group by all")
view("mask", "pattern off", """
select p.cal_id, p.ord, p.x, d.y + p.yc - 2 as y, p.yc
from pattern p left join off o using (cal_id, ord), range(0, 5) d(y)
where (o.off is null or p.x < o.off) and d.y + p.yc - 2 >= 0""")
view("sums", "frames mask", """
select f.shot, f.frame, m.ord, m.x, sum(f.counts)::bigint as counts
from frames f join mask m using (cal_id, y, x) group by all""")
view("short", "pattern mask", """
select p.cal_id, p.ord, coalesce(m.x_missing, 0) as x_missing, p.lowest
from (select cal_id, ord, min(yc) as lowest from pattern group by all) p
left join (select cal_id, ord, max(x) + 1 as x_missing from mask group by all) m using (cal_id, ord)
where coalesce(m.x_missing, 0) < 64""")
view("image_sums", "images mask", """
select m.cal_id, m.ord, m.x, sum(i.sphere)::bigint as sphere, sum(i.dark)::bigint as dark
from images i join mask m using (cal_id, y, x) group by all""")

# --- wavelength -----------------------------------------------------------------------

view("wl_full", "wl_fit", f"select cal_id, ord, x.x, {poly('x.x')} as wl from wl_fit, range(0, 64) x(x)")
view("wl", "wl_full short", """
select cal_id, ord, x, case when x_missing is null or x < x_missing then wl end as wl
from wl_full left join short using (cal_id, ord)""")
view("turn", "wl", """
select c.cal_id, e.direction from (select distinct cal_id from wl) c left join (
  select w.cal_id, sign(arg_max(wl, x) - arg_min(wl, x))::double as direction
  from wl w join (select cal_id, min(ord) as low from wl where wl is not null group by 1) l on l.cal_id = w.cal_id and l.low = w.ord
  where wl is not null group by 1) e using (cal_id)""")
view("lamp", "", """
select l_suppkey as cal_id, (l_linenumber::bigint - 1) % 4 as ord, (l_orderkey * 3 + l_partkey) % 64 + w.d as x,
       sum(l_quantity::bigint * w.w)::bigint as counts
from lineitem, (values (-2, 1), (-1, 3), (0, 5), (1, 3), (2, 1)) w(d, w)
group by all""")
view("flat", "image_sums lamp", """
select cal_id, ord, x, (counts - low)::double / nullif(sphere, 0) as flat
from (select *, min(counts) over (partition by cal_id, ord) as low from lamp) join image_sums using (cal_id, ord, x)""") 
view("wanted", "", """
select distinct l_suppkey as cal_id, (l_linenumber::bigint - 1) % 4 as ord, (l_orderkey * 3 + l_partkey) % 8 * 8 + 4 as px0
from lineitem""")
view("wins", "flat wanted", """
select cal_id, ord, px0, x, flat - min(flat) over (partition by cal_id, ord, px0) as level
from flat join wanted using (cal_id, ord) where x >= px0 - 4 and x < px0 + 4""")
view("pts", "wl image_sums", """
select cal_id, ord, x, wl, sphere::double as s from wl join image_sums using (cal_id, ord, x) where wl is not null""")
view("ends", "pts", """
select cal_id, ord, count(*) as n, arg_min(wl, x) as w0, arg_max(wl, x) as w1 from pts group by all""")
view("pairs", "ends", """
select a.cal_id, a.ord, b.ord as next_ord, b.n, list_sort([a.w0, a.w1, b.w0, b.w1])[2] as lo, list_sort([a.w0, a.w1, b.w0, b.w1])[3] as hi
from ends a join ends b on a.cal_id = b.cal_id
 and b.ord = (select min(c.ord) from ends c where c.cal_id = a.cal_id and c.ord > a.ord)""")
view("grid", "pairs", """
select cal_id, ord, next_ord, i, case when i = n - 1 then hi else i::double * ((hi - lo) / (n - 1)) + lo end as g
from (select *, unnest(range(0, n)) as i from pairs where n > 1)""")
view("segs", "pts", """
select cal_id, ord, wl, s, lead(wl) over w as wl1, lead(s) over w as s1, lag(wl) over w is null as first
from pts window w as (partition by cal_id, ord order by wl)""")
view("gap", "grid segs", """
select g.cal_id, g.ord, g.i, g.g,
       case when g.g = a.wl1 then a.s1 when g.g = a.wl then a.s else a.s + (a.s1 - a.s) / (a.wl1 - a.wl) * (g.g - a.wl) end as v0,
       case when g.g = b.wl1 then b.s1 when g.g = b.wl then b.s else b.s + (b.s1 - b.s) / (b.wl1 - b.wl) * (g.g - b.wl) end as v1
from grid g
join segs a on a.cal_id = g.cal_id and a.ord = g.ord and g.g <= a.wl1 and (g.g > a.wl or (a.first and g.g = a.wl))
join segs b on b.cal_id = g.cal_id and b.ord = g.next_ord and g.g <= b.wl1 and (g.g > b.wl or (b.first and g.g = b.wl))""")
view("crossings", "pairs gap", """
select p.cal_id, p.ord, p.next_ord, c.crossing from pairs p
left join (select cal_id, ord, arg_min(g, {'d': abs(v0 - v1), 'i': i}) as crossing from gap group by all) c using (cal_id, ord)""")
view("knots_of_pairs", "pairs pts segs", """
select g.*, case when g.g = a.wl1 then a.s1 when g.g = a.wl then a.s else a.s + (a.s1 - a.s) / (a.wl1 - a.wl) * (g.g - a.wl) end as v0,
       case when g.g = b.wl1 then b.s1 when g.g = b.wl then b.s else b.s + (b.s1 - b.s) / (b.wl1 - b.wl) * (g.g - b.wl) end as v1
from (select distinct p.cal_id, p.ord, p.next_ord, t.wl as g from pairs p join pts t on t.cal_id = p.cal_id and t.ord in (p.ord, p.next_ord)) g
join segs a on a.cal_id = g.cal_id and a.ord = g.ord and g.g <= a.wl1 and (g.g > a.wl or (a.first and g.g = a.wl))
join segs b on b.cal_id = g.cal_id and b.ord = g.next_ord and g.g <= b.wl1 and (g.g > b.wl or (b.first and g.g = b.wl))""")
view("every_crossing", "knots_of_pairs", """
select cal_id, ord, next_ord, case when d = 0 then g else g + (g1 - g) * (d / (d - d1)) end as wl,
       case when d = 0 then v0 else v0 + (w0 - v0) * (d / (d - d1)) end as level
from (select *, v0 - v1 as d, lead(g) over k as g1, lead(v0) over k as w0, lead(v0 - v1) over k as d1
      from knots_of_pairs window k as (partition by cal_id, ord, next_ord order by g))
where d = 0 or (d < 0 and d1 > 0) or (d > 0 and d1 < 0)""")
view("borders", "wl turn crossings", """
select o.cal_id, o.ord, coalesce(s.x_from, 0) as x_from, coalesce(e.x_to, 64) as x_to,
       (s.x_from is not null or o.ord = o.lowest) and (e.x_to is not null or o.ord = o.highest) as trimmed
from (select cal_id, ord, min(ord) over (partition by cal_id) as lowest, max(ord) over (partition by cal_id) as highest
      from wl where wl is not null group by cal_id, ord) o
left join (select cal_id, ord, 1 + case when any_value(direction) < 0 then max(x) else min(x) end as x_to
           from wl left join turn using (cal_id) join crossings using (cal_id, ord) where wl > crossing group by all) e using (cal_id, ord)
left join (select w.cal_id, w.ord, case when any_value(direction) < 0 then min(x) else max(x) end as x_from
           from wl w join turn using (cal_id) join crossings c on c.cal_id = w.cal_id and c.next_ord = w.ord
           where wl <= crossing group by all) s using (cal_id, ord)""")
view("pixels", "wl borders turn", """
select cal_id, ord, x, wl, seq, case when direction < 0 then n - 1 - seq else seq end as pos from (
  select cal_id, ord, x, wl, direction, row_number() over (partition by cal_id order by ord, x) - 1 as seq,
         count(*) over (partition by cal_id) as n
  from wl join borders using (cal_id, ord) join turn using (cal_id) where x between x_from and x_to and wl is not null)""")
view("stitched", "sums stacks pixels", """
select s.shot, s.cal_id, c.frame, p.ord, p.x, p.wl, p.seq, p.pos, c.counts
from sums c join stacks s using (shot) join pixels p on p.cal_id = s.cal_id and p.ord = c.ord and p.x = c.x""")

# --- absolute ----------------------------------------------------------------------------

view("knot_segs", "knots", """
select cal_id, um * 1000 as nm, mw, lead(um * 1000) over w as nm1, lead(mw) over w as mw1
from knots window w as (partition by cal_id order by um)""")
view("irr", "pixels knot_segs", """
select p.cal_id, p.ord, p.x, p.wl, k.mw + (p.wl - k.nm) / (k.nm1 - k.nm) * (k.mw1 - k.mw) as irradiance
from pixels p join knot_segs k on k.cal_id = p.cal_id and p.wl > k.nm and p.wl <= k.nm1""")
# the knots lie on a cubic, which a not-a-knot spline gives back exactly
view("irr_cubic", "pixels", """
select cal_id, ord, x, wl, (i + 1) * (i + 1) * (30 - i) / 20 + cal_id % 7 as irradiance from (select *, (wl - 300) / 84e0 as i from pixels)""")
for end in ("", "_cubic"):
    view(f"factors{end}", f"irr{end} image_sums exposures", f"""
select *, f_wmsr * {4 * 3.141592653589793!r}::double as f_wm,
       f_wmsr * wl * 1e-9 / {LIGHT_SPEED * PLANCK!r}::double as f_phmsr
from (select i.cal_id, i.ord, i.x, i.wl, i.irradiance * e.exposure_s / nullif(m.sphere - m.dark, 0) * 1e-2 as f_wmsr
      from irr{end} i join image_sums m using (cal_id, ord, x) join exposures e using (cal_id))""")
view("calibrated", "stitched factors stacks", """
select s.shot, s.frame, s.ord, s.x, s.seq, s.wl, s.counts, s.counts * f.f_wm / k.exposure_s as wm,
       s.counts * f.f_wmsr / k.exposure_s as wmsr, s.counts * f.f_phmsr / k.exposure_s as phmsr
from stitched s join factors f on f.cal_id = s.cal_id and f.ord = s.ord and f.x = s.x join stacks k on k.shot = s.shot""")


# --- background and bands: views made for several sources ------------------------------------

def quiet(name, source, k):
    view(f"{name}_quiet", source, f"""
    select *, top <= mean + {k}::double * sd as quiet from (
      select shot, frame, max(counts) as top, avg(counts) as mean, stddev_pop(counts) as sd from {source} group by all)""")
    view(f"{name}_run", f"{name}_quiet", f"""
    select shot, first as run_first, last as run_last, n as run_n from (
      select *, row_number() over (partition by shot order by n desc, first) as rk from (
        select shot, min(frame) as first, max(frame) as last, count(*) as n from (
          select shot, frame, frame - row_number() over (partition by shot order by frame) as island
          from {name}_quiet where quiet) group by shot, island)) where rk = 1""")


quiet("ev", "event_spectra", 2.0)
quiet("ev1", "event_spectra", 1.1)
quiet("st", "stitched", 2.6)
view("net", "stitched st_run stacks", """
select s.shot, s.cal_id, s.frame, s.ord, s.x, s.seq, s.wl,
       s.counts - avg(case when s.frame between r.run_first and r.run_last then s.counts end)
         over (partition by s.shot, s.ord, s.x) as counts
from stitched s left join st_run r using (shot)""")
for end in ("", "_cubic"):
    view(f"net_wm{end}", f"net factors{end} stacks", f"""
select n.shot, n.frame, n.seq, n.wl, n.counts * f.f_wm / k.exposure_s as wm
from net n join factors{end} f on f.cal_id = n.cal_id and f.ord = n.ord and f.x = n.x join stacks k on k.shot = n.shot""")


def slices(name, source, pad):
    view(f"{name}_slices", f"{source} small_bands", f"""
    select c.shot, c.frame, b.band, c.wl, c.seq, c.wm as y, c.wl >= b.lo and c.wl <= b.hi as core
    from {source} c join small_bands b on c.wl >= b.lo - {pad}::double and c.wl <= b.hi + {pad}::double""")
    view(f"{name}_core", f"{name}_slices", f"""
    select shot, frame, band, wl, seq, y - (a * wl + (c1 - a * first_wl)) as y from (
      select *, (c2 - c1) / nullif(d2 - d1, 0) as a from (
        select *, avg(case when rn <= d then y end) over p as c1, avg(case when rn > n - d then y end) over p as c2,
               avg(case when rn <= d then wl end) over p as d1, avg(case when rn > n - d then wl end) over p as d2,
               min(wl) over p as first_wl
        from (select *, greatest(5, floor(n * 0.01e0)::bigint) as d from (
                select *, row_number() over (partition by shot, frame, band order by wl, seq) as rn,
                       count(*) over (partition by shot, frame, band) as n from {name}_slices))
        window p as (partition by shot, frame, band))) where core""")
    view(f"{name}_int", f"{name}_core", integral(f"{name}_core"))


def integral(source):
    return f"""
    select shot, frame, band, case when count(y) = count(*) then coalesce(sum(step), 0e0) end as intensity from (
      select shot, frame, band, y, (y + lag(y) over w) / 2 * (wl - lag(wl) over w) as step from {source}
      window w as (partition by shot, frame, band order by wl, seq)) group by all"""


slices("cal", "calibrated", 1.0)
slices("netb", "net_wm", 1.0)
slices("netc", "net_wm_cubic", 1.0)
view("detected", "cal_core", """
select *, not (top < sd + mean + 2e0 and top < 40e0) as signal from (
  select shot, frame, band, max(y) as top, avg(y) as mean, stddev_pop(y) as sd from cal_core group by all)""")


def weights(source):
    return f"""
    select *, case when j2 like '%*%' then 2e0 * (2e0 * (instr('spdfghik', right(config, 1)) - 1) + 1)
              else 2 * case when contains(j2, '/') then
                     coalesce(try_cast(nullif(regexp_extract(j2, '^(-?[0-9]+) ', 1), '') as double), 0e0)
                     + cast(regexp_extract(j2, '(-?[0-9]+)/', 1) as double) / cast(regexp_extract(j2, '/([0-9]+)', 1) as double)
                   else cast(j2 as double) end + 1 end as g
    from (select *, split_part(j, '-', 2) as j2 from {source})"""


view("atomic_g", "atomic", weights("atomic"))
view("small_g", "small_lines", weights("small_lines"))
view("ratios", "small_g", """
select band, line, first_value(wl) over w as wl0, wl - first_value(wl) over w as "offset",
       ak * g / first_value(ak * g) over w as ratio from small_g window w as (partition by band order by line)""")

NORM = "sqrt(6.283185307179586::double)"


def node(name, source, steps):
    """Best grid node per slice; ``source`` has the points and the grid's box."""
    view(f"{name}_m", f"{source} ratios", f"""
    select shot, frame, band, wl, seq, y, node, centre, sigma,
           sum(ratio * exp(-(wl - centre - "offset") * (wl - centre - "offset") / (2 * sigma * sigma))) / ({NORM} * sigma) as m
    from (select p.*, n.node, c_lo + (c_hi - c_lo) * (n.node // {steps}) / {steps - 1} as centre,
                 s_lo + (s_hi - s_lo) * (n.node % {steps}) / {steps - 1} as sigma
          from {source} p, range(0, {steps * steps}) n(node)) join ratios using (band)
    group by shot, frame, band, wl, seq, y, node, centre, sigma""")
    view(name, f"{name}_m", f"""
    select shot, frame, band, centre, sigma, delta from (
      select *, row_number() over (partition by shot, frame, band order by delta * ym desc, node) as rk from (
        select *, case when mm > 0 and ym > 0 then ym / mm else 0e0 end as delta from (
          select shot, frame, band, node, centre, sigma, sum(y * m) as ym, sum(m * m) as mm from {name}_m group by all)))
    where rk = 1""")


view("box1", "cal_core ratios", """
select c.*, wl0 - 0.8e0 as c_lo, wl0 + 0.8e0 as c_hi, 0.3e0 as s_lo, 1.5e0 as s_hi
from cal_core c join (select distinct band, wl0 from ratios) using (band)""")
node("best1", "box1", 9)
view("box2", "cal_core best1", """
select c.*, b.centre - 0.2e0 as c_lo, b.centre + 0.2e0 as c_hi,
       greatest(0.3e0, b.sigma - 0.15e0) as s_lo, least(1.5e0, b.sigma + 0.15e0) as s_hi
from cal_core c join best1 b using (shot, frame, band)""")
node("best2", "box2", 9)
view("samples", "best2 cal_core ratios", f"""
select shot, frame, band, line, i, x,
       delta * ratio / ({NORM} * sigma) * exp(-((x - centre - "offset") / sigma) * ((x - centre - "offset") / sigma) / 2) as y
from (select *, case when i = points - 1 then hi else i::double * ((hi - lo) / (points - 1)) + lo end as x
      from (select *, unnest(range(0, points)) as i
            from (select shot, frame, band, min(wl) as lo, max(wl) as hi, count(*) * 3 as points from cal_core group by all)))
join best2 using (shot, frame, band) join ratios using (band)""")
view("sampled", "samples", """
select shot, frame, band, x as wl, i as seq, sum(y) as y from samples group by all""")
view("fit_int", "sampled", integral("sampled"))

# --- profiles and peaks -------------------------------------------------------------------

view("profiles", "frames", "select shot, frame, x, y, counts from frames where x in (4, 11, 18, 25, 32, 39, 46, 53, 60)")
view("smooth", "profiles", """
select shot, frame, x, y, counts, case
  when y < 2 then regr_intercept(v, y) filter (y < 5) over p + regr_slope(v, y) filter (y < 5) over p * y
  when y >= n - 2 then regr_intercept(v, y) filter (y >= n - 5) over p + regr_slope(v, y) filter (y >= n - 5) over p * y
  else avg(v) over (partition by shot, frame, x order by y rows between 2 preceding and 2 following) end as smooth
from (select *, counts::double as v, count(*) over (partition by shot, frame, x) as n from profiles)
window p as (partition by shot, frame, x)""")
view("all_peaks", "profiles", """
select shot, frame, x, y, counts as height from (
  select *, lead(counts) over w as after from (
    select *, lag(counts) over w as before, 0.06e0 * (max(counts) over p - min(counts) over p) + min(counts) over p as level
    from profiles window w as (partition by shot, frame, x order by y), p as (partition by shot, frame, x))
  where before is null or counts <> before window w as (partition by shot, frame, x order by y))
where counts > before and counts > after and counts > level""")
view("greedy", "all_peaks", """
select shot, frame, x, list({'h': height, 'y': y} order by height desc, y desc) as rest, []::struct(h bigint, y bigint)[] as kept
from all_peaks group by all
union all
select shot, frame, x, list_filter(rest, lambda p: abs(p.y - rest[1].y) > 3), list_append(kept, rest[1])
from greedy where len(rest) > 0""")
view("peaks", "greedy", """
select shot, frame, x, p.y as y, p.h as height from (select shot, frame, x, unnest(kept) as p from greedy where len(rest) = 0)""")
view("numbered", "peaks", """
select *, row_number() over (partition by shot, frame, x order by y) - 1 as ord from peaks""")
# one sampled column keeps a single peak
view("few_peaks", "numbered", "select * from numbered where x <> 60 or ord = 0")
view("spacing0", "few_peaks", """
select *, ord - (m - 1) / 2 as t from (
  select shot, frame, x, ord, y, count(*) over (partition by shot, frame, x)::double as m,
         (case when lag(y) over w is null then lead(y) over w - y when lead(y) over w is null then y - lag(y) over w
              else (lead(y) over w - lag(y) over w) / 2e0 end)::double as spacing
  from few_peaks window w as (partition by shot, frame, x order by ord))""")
_beta = lambda k: f"({float(k * k)!r}::double * (m * m - {float(k * k)!r}::double) / {float(4 * (4 * k * k - 1))!r}::double)"
view("spacing", "spacing0", """
select shot, frame, x, ord, y, spacing, """ + " + ".join(
    f"case when m > {k} then p{k} * (sum(p{k} * spacing) over w) / (sum(p{k} * p{k}) over w) else 0 end" for k in range(5)) + f"""
 as smooth_spacing from (
  select *, t * p3 - {_beta(3)} * p2 as p4 from (
    select *, t * p2 - {_beta(2)} * t as p3 from (
      select *, 1e0 as p0, t as p1, t * t - {_beta(1)} as p2 from spacing0)))
window w as (partition by shot, frame, x)""")

# --- queries ------------------------------------------------------------------------------

SQL = {}


def sql(name, needs, body):
    SQL[name] = query(needs, body)


FRAME = "shot, frame, y, x, counts"

sql("shot_index", "", """
select shot, arg_max(path, {'t': t, 'p': path}) as path from (
  select 100000 + o_custkey as shot, o_orderdate as t, 'data/' || (o_orderkey % 7) || '/' || (100000 + o_custkey) || '_image.SIF' as path
  from orders where o_orderkey % 97 <> 0) group by shot""")
sql("unnumbered_files", "", """
select 'data/' || (o_orderkey % 7) || '/calib_image.SIF' as path, count(*)::bigint as n from orders where o_orderkey % 97 = 0 group by 1""")
sql("shot_range", "shots", "select min(shot) as first_shot, max(shot) as last_shot from shots")
sql("scan_frames", "frames", f"select {FRAME} from frames")
sql("frame_store", "frames", f"select {FRAME} from frames")
sql("stack_scan", "frames", f"select {FRAME} from frames")
sql("stack_range", "frames", f"select {FRAME} from frames where shot >= 1 and frame between 3 and 6")
sql("file_index", "frames", "select shot, count(distinct frame // 4) as n_files from frames group by shot")
sql("spectra_store", "event_spectra", "select shot, frame, x as seq, counts from event_spectra")
sql("shots_meta", "shots", f"""
select shot, path, 'cam' as camera, n_frames, {R("case when shot % 4 <> 0 then exposure_s else 1e0 end")} as exposure_s,
       cycle_s, xbin, ybin, dim_w, dim_o, -20.5e0 as temp_c from shots""")
sql("line_list", "", """
select l_suppkey as cal_id, l_linenumber::bigint - 1 as ord, (l_orderkey % 1024)::double as px_from,
       (l_orderkey % 1024 + 10)::double as px_to, l_orderkey % 1024 + 5.25e0 as px, 400 + l_partkey % 400 + 0.5e0 as wl,
       'ArI' as species from lineitem where l_linenumber not in (6, 7)""")
sql("irradiance", "", """
select p_partkey % 10 as cal_id, ((p_partkey + 300) || 'e-3')::double as um, (p_partkey % 9 + 1.5e0) * 10 as mw
from part where p_partkey % 50 <> 0""")
sql("pattern_scan", "pattern", "select cal_id, ord, x, yc from pattern")
sql("export_pattern", "pattern", """
select c.cal_id as shot, 1 as part, c.x as line, string_agg(coalesce(p.yc::varchar, 'nan'), ' ' order by c.ord) as text
from (select cal_id, x, unnest(range(top + 1)) as ord from (
        select distinct cal_id, x, max(ord) over (partition by cal_id) as top from pattern)) c
left join pattern p on p.cal_id = c.cal_id and p.x = c.x and p.ord = c.ord group by 1, 3""")


def header(lines):
    """SQL list of header lines; each is an SQL string expression."""
    return "[" + ", ".join(lines) + "]"


def lit(s):
    return "'" + s.replace("'", "''") + "'"


sql("export_spectra", "event_spectra", f"""
select shot, 1 as part, x as line, printf('%.6f', 600 + x / 8e0) || ', '
       || string_agg(coalesce(printf('%.6e', counts * 0.001e0), 'nan'), ', ' order by frame) as text
from (select c.shot, c.x, c.frame, s.counts from (
        select shot, x, unnest(range(n)) as frame from (select distinct shot, x, max(frame) over (partition by shot) + 1 as n from event_spectra)) c
      left join event_spectra s using (shot, x, frame)) group by shot, x
union all
select shot, 0, unnest(range(0, len(h))), unnest(h) from (
  select shot, """ + header([
    lit("# [Parameters]"), lit("# Name = 'Spectra'"), "'# ShotNo = ' || shot", lit(f"# Date = '{DATE}'"), lit("#"),
    lit("# DimNo = 1"), lit("# DimName = 'wavelength'"), "'# DimSize = ' || n", lit("# DimUnits = 'nm'"), lit("#"),
    "'# ValNo = ' || n", "'# ValName = ' || array_to_string(list_transform(range(0, n), lambda i: '''' || i || ''''), ',')",
    f"'# ValUnit = ' || array_to_string(list_transform(range(0, n), lambda i: '''{UNITS['wm']}'''), ',')",
    lit("#"), lit("# [Comments]"), lit("# time = 2.75 + frameNo*0.25 (s)"), lit("# exposure = 0.5 (s)"), lit("#"),
    lit("# [Data]")]) + """ as h
  from (select shot, max(frame) + 1 as n from event_spectra group by shot))""")
EVENT_BANDS = ["click", "error", "purchase", "signup", "view"]
view("event_table", "event_values event_shots", "select shot, frame, trig_delay_s + frame * cycle_s as time_s, " + ", ".join(
    f"max(case when band = '{b}' then intensity end) as {b}" for b in EVENT_BANDS)
    + " from event_values join event_shots using (shot) where frame >= 1 group by all")
sql("export_intensities", "event_table", """
select shot, 1 as part, frame as line, printf('%.5f', time_s) || ', ' || """ + " || ', ' || ".join(
    f"case when {b} is null then 'nan' else printf('%.6e', {b}) end" for b in EVENT_BANDS) + """ as text from event_table
union all
select shot, 0, unnest(range(0, len(h))), unnest(h) from (select shot, """ + header([
    lit("# [Parameters]"), lit("# Name = 'lines'"), "'# ShotNo = ' || shot", lit(f"# Date = '{DATE}'"), lit("#"),
    lit("# DimNo = 1"), lit("# DimName = 'Time'"), "'# DimSize = ' || n", lit("# DimUnit = 's'"), lit("#"),
    lit("# ValNo = 5"), lit("# ValName = " + ",".join(f"'{b}'" for b in EVENT_BANDS)),
    lit("# ValUnit = " + ",".join(["'W/m^2'"] * 5)), lit("#"), lit("# [Comments]"), lit("# Line intensities."),
    lit("# time = 2.75 + frameNo*0.25 (s)"), lit("#"), lit("# [Data]")]) + """ as h
  from (select shot, count(*) as n from event_table group by shot))""")
for name, lines in (("spectra_files", "export_spectra"), ("intensity_files", "export_intensities")):
    SQL[name] = f"""select shot, row_number() over (partition by shot order by part, line) - 1 as number, text from ({SQL[lines]})"""
sql("pending_shots", "shots", "select shot, path from shots where o_orderstatus <> 'F'")
sql("band_lines", "measured cat_bounds cat_lines", f"""
select b.band, (select count(*) from cat_lines l where l.band = b.band) as n_lines, {R('b.lo')} as lo, {R('b.hi')} as hi,
       count(*) as points, sum(m.counts)::bigint as total
from measured m join cat_bounds b on m.wl >= b.lo and m.wl <= b.hi group by b.band, b.lo, b.hi""")
sql("cal_registry", "", """
select cal_id, camera, role, file, 'cal/' || file as path from (
  select s_suppkey as cal_id, case when s_suppkey % 2 = 0 then 'first' else 'second' end as camera,
         unnest(['orders', 'wavelength', 'sphere', 'dark', 'irradiance']) as role,
         unnest(['orders_' || s_suppkey || '.txt', 'lines_' || s_suppkey || '.txt', 'sphere_' || s_suppkey || '.txt',
                 'dark_' || s_suppkey || '.txt', 'lamp.txt']) as file from supplier)""")

sql("transpose", "frames", "select shot, frame, x as y, y as x, counts from frames")
sql("crop", "frames", "select shot, frame, y - 3 as y, x, counts from frames where y >= 3 and y < 24")
sql("unbin", "frames stacks", """
select shot, frame, y * ybin + dy as y, x * xbin + dx as x, counts from (
  select f.shot, f.frame, f.y, f.x, f.counts, s.xbin, s.ybin, dy, unnest(range(0, s.xbin)) as dx
  from frames f join stacks s using (shot), range(0, 2) t(dy))""")
sql("mean_frame", "frames", f"select shot, y, x, {R('avg(counts)')} as counts from frames group by all")
sql("frame_diff", "sums", f"""
select shot, ord, x, {R('''(sum(case when frame between 3 and 6 then counts end)
       - sum(case when frame = 0 then counts end) * 4) / 4e0''')} as diff from sums group by all""")
sql("dark_subtract", "frames images", """
select shot, frame, y, x, counts - dark as counts from frames join images using (cal_id, y, x)""")
sql("contrast", "frames", f"""
select shot, frame, {R('quantile_cont(counts, 0.01)')} as low, {R('quantile_cont(counts, 0.99)')} as high from frames group by all""")
sql("extrema", "frames", "select shot, frame, min(counts) as low, max(counts) as high from frames group by all")
sql("subtract_min", "frames", """
select shot, frame, y, x, counts - min(counts) over (partition by shot, frame) as counts from frames""")
sql("blank_outside", "frames", """
select shot, frame, y, x, case when y < greatest(0, trunc(0.1e0 * x - 2.5e0)) or y >= greatest(0, trunc(0.1e0 * x + 15.3e0))
  then min(counts) over (partition by shot, frame) else counts end as counts from frames""")
sql("dim_mismatch", "shots", """
select shot as cal_id, dim_w * xbin as sphere_w, dim_o * ybin as sphere_o, dim_w * xbin as dark_w, dim_o * (ybin + 1) as dark_o
from shots where shot % 13 = 0""")
sql("assign_cal", "shots", """
select shot, dim_w, dim_o, (case when dim_w = 1024 and dim_o = 1024 then 1 when dim_w = 2048 and dim_o = 2048 then 2 end)::bigint as cal_id
from shots""")
sql("row_slice", "frames", "select shot, frame, x, counts from frames where y = 12")
sql("column_slice", "frames", "select shot, frame, x, y, counts from frames where x = 32")

sql("sample_columns", "profiles", "select shot, frame, x, y, counts from profiles")
sql("savgol", "smooth", f"select shot, frame, x, y, counts, {R('smooth')} as smooth from smooth")
sql("amplify", "smooth", f"""
select shot, frame, x, y, {R('smooth * exp(3e-3 * y)')} as exp,
       {R('smooth * (1 + (1e-3 * (y - 10)) * (1e-3 * (y - 10)))', 8)} as arch from smooth""")
sql("local_peaks", "all_peaks", """
select a.shot, a.frame, a.x, a.y, a.height from all_peaks a where not exists (
  select 1 from all_peaks b where b.shot = a.shot and b.frame = a.frame and b.x = a.x and b.y between a.y - 3 and a.y + 3
  and (b.height > a.height or (b.height = a.height and b.y > a.y)))""")
sql("peaks", "peaks", "select shot, frame, x, y, height from peaks")
sql("peak_count_check", "peaks", """
select shot, frame, min(n) as least, max(n) as most, count(*) as columns, min(n) = max(n) as consistent
from (select shot, frame, x, count(*) as n from peaks group by all) group by all""")
sql("peak_overrides", "numbered", """
select shot, frame, x, y, row_number() over (partition by shot, frame, x order by y) - 1 as ord from (
  select shot, frame, x, y from numbered where ord <> 0 union all select shot, frame, x, y + 1 from numbered where ord = 2)""")
sql("order_curve_fit", "curve", f"""
select shot, frame, ord, n, {R('c0')} as c0, {R('c1', 2)} as c1, {R('c2 / 1000', 2)} as c2 from curve""")
sql("order_curve_eval", "curve", f"""
select shot, frame, ord, x, case when v between 0 and 43 then trunc(v)::bigint end as yc
from (select shot, frame, ord, x.x, {poly('x.x')} as v from curve, range(0, 64) x(x))""")
sql("order_spacing", "spacing", f"""
select shot, frame, x, ord, y, {R('spacing')} as spacing, {R('smooth_spacing')} as smooth_spacing from spacing""")
view("cuts", "spacing", """
select shot, frame, x, ord, y as yc, case when smooth_spacing is not null then least(trunc(smooth_spacing / 2)::bigint + 2, y, 25 - y) end as w
from spacing""")
sql("order_profile", "cuts profiles", f"""
select shot, frame, x, ord, y - yc as dy,
       {R("(counts - min(counts) over k)::double / nullif(max(counts) over k - min(counts) over k, 0)")} as z
from cuts join profiles using (shot, frame, x)
where w > 0 and y >= yc - w and y < yc + w window k as (partition by shot, frame, x, ord)
union all select shot, frame, x, ord, null, null from cuts where w is null or w <= 0""")

sql("make_mask", "pattern", "select cal_id, ord, x, d.y + yc - 2 as y from pattern, range(0, 5) d(y)")
sql("truncate_mask", "mask", "select cal_id, ord, x, y from mask")
sql("pattern_image", "mask", "select distinct cal_id, y, x from mask")
sql("order_image", "frames mask", """
select f.shot, f.frame, m.ord, f.y - m.yc + 2 as dy, m.x, f.counts from frames f join mask m using (cal_id, y, x)""")
sql("order_spectra", "sums", "select shot, frame, ord, x, counts from sums")
SQL["order_spectra_stored"] = SQL["order_spectra"]
sql("pad_orders", "sums frames pattern", """
select o.shot, o.frame, o.ord, x.x, s.counts
from (select f.shot, f.frame, p.ord from (select distinct shot, frame, cal_id from frames) f
      join (select distinct cal_id, ord from pattern union select cal_id, 4 from pattern) p using (cal_id)) o cross join range(0, 64) x(x)
left join sums s on s.shot = o.shot and s.frame = o.frame and s.ord = o.ord and s.x = x.x""")
sql("short_orders", "short", "select cal_id, ord, x_missing, lowest from short")

sql("dispersion_fit", "lamp_fit", f"""
select cal_id, ord, n, degree, {R(poly('0.1234567e0'), 3)} as wl_a, {R(poly('31.7654321e0'), 3)} as wl_b, {R(poly('62.9182736e0'), 3)} as wl_c from lamp_fit""")
sql("wavelength_map", "wl_full", f"select cal_id, ord, x, {R('wl')} as wl from wl_full")
sql("wavelength_blank", "wl", f"select cal_id, ord, x, {R('wl')} as wl from wl")
sql("direction", "turn", "select cal_id, direction from turn")
sql("flat_field", "flat", f"select cal_id, ord, x, {R('flat', 12)} as flat from flat")
sql("line_center_seed", "wins", f"""
select cal_id, ord, px0, {R('x + case when bend < 0 then (a - c) / 2 / bend else 0e0 end')} as centre from (
  select *, a - 2 * b + c as bend from (
    select cal_id, ord, px0, x, ln(l) as a, ln(level) as b, ln(r) as c,
           row_number() over (partition by cal_id, ord, px0 order by level desc, x) as rk from (
      select *, lag(level) over w as l, lead(level) over w as r from wins
      window w as (partition by cal_id, ord, px0 order by x)) where level > 0 and l > 0 and r > 0) where rk = 1)""")
sql("calib_residuals", "line_list wl_fit", f"""
select cal_id, ord, count(*) as n, {R('max(abs(miss))', 6)} as worst, {R('sqrt(avg(miss * miss))', 6)} as rms from (
  select l.cal_id, l.ord, l.wl - {poly('l.px')} as miss from line_list l join wl_fit using (cal_id, ord)) group by all""")
sql("all_crossings", "every_crossing", f"select cal_id, ord, next_ord, {R('wl')} as wl, {R('level')} as level from every_crossing")
sql("order_crossings", "crossings", f"select cal_id, ord, next_ord, {R('crossing')} as cross from crossings")
sql("order_borders", "borders", "select cal_id, ord, x_from, x_to, trimmed from borders")
sql("stitched_spectra", "stitched", f"select shot, frame, ord, x, seq, {R('wl')} as wl, counts from stitched")

sql("irradiance_linear", "irr", f"select cal_id, ord, x, {R('wl')} as wl, {R('irradiance')} as irradiance from irr")
sql("irradiance_cubic", "irr_cubic", f"select cal_id, ord, x, {R('wl')} as wl, {R('irradiance')} as irradiance from irr_cubic")
sql("sphere_net", "image_sums", "select cal_id, ord, x, sphere - dark as net from image_sums")
sql("absolute_factors", "factors", f"""
select cal_id, ord, x, {R('wl')} as wl, {R('f_wm', 6)} as f_wm, {R('f_wmsr', 6)} as f_wmsr, {R('f_phmsr / 1e15')} as f_phmsr_e15
from factors""")
sql("calibrated", "calibrated", f"""
select shot, frame, ord, x, counts, {R('wm')} as wm, {R('wmsr')} as wmsr, {R('phmsr / 1e15', 2)} as phmsr_e15 from calibrated""")
sql("unit_unpivot", "calibrated", f"""
select shot, frame, ord, x, unit, {R('value', 2)} as value,
       case unit when 'counts' then '{UNITS['counts']}' when 'wm' then '{UNITS['wm']}' when 'wmsr' then '{UNITS['wmsr']}'
       else '{UNITS['phmsr']}' end as label
from (select shot, frame, ord, x, unnest(['counts', 'wm', 'wmsr', 'phmsr']) as unit,
             unnest([counts::double, wm, wmsr, phmsr / 1e15]) as value from calibrated)""")
sql("wavelength_order", "stitched", "select shot, frame, ord, x, pos from stitched")
sql("select_unit", "calibrated", f"""
select shot, frame, ord, x, ['counts', 'wm', 'wmsr'][shot % 3 + 1] as unit,
       ['{UNITS['counts']}', '{UNITS['wm']}', '{UNITS['wmsr']}'][shot % 3 + 1] as label,
       {R('case shot % 3 when 0 then counts::double when 1 then wm else wmsr end', 3)} as value from calibrated""")
sql("bg_file_subtract", "calibrated", f"""
select a.shot, a.frame, a.ord, a.x, {R('a.wm - b.wm')} as wm from calibrated a
left join calibrated b on b.shot + 1 = a.shot and b.frame = 0 and b.ord = a.ord and b.x = a.x""")

sql("quiet_frames", "ev_quiet", f"select shot, frame, top, {R('mean')} as mean, {R('sd')} as sd, quiet from ev_quiet")
sql("longest_run", "ev_run", "select shot, run_first, run_last, run_n from ev_run")
sql("bg_subtract", "event_spectra ev_run", f"""
select shot, frame, ord, x, {R('''counts - avg(case when frame between run_first and run_last then counts end)
  over (partition by shot, ord, x)''')} as counts, run_n is not null as background
from event_spectra left join ev_run using (shot)""")
sql("bg_summary", "event_spectra ev1_run", """
select shot, case when run_n is null then 'None' else '[' || run_first || '..' || run_last || '] (' || run_n || ')' end as background
from (select distinct shot from event_spectra) left join ev1_run using (shot)""")

view("at_bounds", "atomic", """
select band, coalesce(case when kind = 'ECONOMY' then lo - 1 end, case when kind = 'SMALL' then hi - 0.5e0 end, mean - 0.3e0) as b_lo,
       coalesce(case when kind = 'ECONOMY' then hi + 1 end, case when kind = 'SMALL' then hi + 0.5e0 end, mean + 0.3e0) as b_hi,
       mean from (select band, split_part(band, '-', 2) as kind, min(wl) as lo, max(wl) as hi, avg(wl) as mean from atomic group by band)""")
sql("band_bounds", "at_bounds", f"select band, {R('b_lo')} as lo, {R('b_hi')} as hi from at_bounds")
sql("stat_weights", "atomic_g", "select band, line, j, config, g from atomic_g")
sql("avg_ak", "atomic_g", f"select band, {R('sum(ak * g) / sum(g)', 2)} as avg_ak from atomic_g group by band")
sql("band_report", "atomic_g at_bounds", """
select band, string_agg(printf('%.3f', wl), ' ' order by line) as lines, printf('%.2f', avg(e_high)) as e_term,
       printf('%.2e', sum(ak * g) / sum(g)) as avg_ak, printf('%.0f', sum(g)) as g_sum,
       printf('%.2f - %.2f (nm)', any_value(mean) - 0.3e0, any_value(mean) + 0.3e0) as bounds
from atomic_g join at_bounds using (band) group by band""")
sql("band_slice", "cal_slices", f"select shot, frame, band, {R('wl')} as wl, seq, {R('y')} as y, core from cal_slices")
sql("line_baseline", "cal_core", f"select shot, frame, band, {R('wl')} as wl, seq, {R('y')} as y from cal_core")
sql("band_intensity", "cal_int", f"select shot, frame, band, {R('intensity')} as intensity from cal_int")
SQL["band_intensity_stored"] = SQL["band_intensity"]
sql("signal_detect", "detected", f"""
select shot, frame, band, {R('top')} as top, {R('mean')} as mean, {R('sd')} as sd, signal from detected""")
sql("band_fit_grid", "best2", f"""
select shot, frame, band, {R('centre')} as centre, {R('sigma')} as sigma, {R('delta')} as delta from best2""")
sql("fit_samples", "samples", f"select shot, frame, band, line, i, {R('x')} as x, {R('y')} as y from samples")
sql("fit_intensity", "fit_int", f"select shot, frame, band, {R('intensity')} as intensity from fit_int")
sql("combined_intensity", "cal_int fit_int detected", f"""
select c.shot, c.frame, c.band, {R('case when d.signal and c.frame >= 1 then f.intensity else c.intensity end')} as intensity
from cal_int c join detected d using (shot, frame, band) left join fit_int f using (shot, frame, band)""")
view("masked", "event_values event_shots", """
select s.shot, f.frame, s.band, v.intensity from (select distinct shot, band from event_values) s cross join range(0, 100) f(frame)
left join event_values v on v.shot = s.shot and v.band = s.band and v.frame = f.frame and v.frame >= 1""")
sql("frame_mask", "masked", f"select shot, frame, band, {R('intensity')} as intensity from masked")
sql("time_axis", "event_values event_shots", f"""
select shot, frame, band, {R('intensity')} as intensity, {R('trig_delay_s + frame * cycle_s')} as time_s
from event_values join event_shots using (shot)""")
sql("intensity_pivot", "event_table", f"select shot, frame, {R('time_s')} as time_s, " + ", ".join(
    f"{R(b)} as {b}" for b in EVENT_BANDS) + " from event_table")
sql("trace", "event_values", f"""
select shot, frame, {R('intensity')} as intensity from event_values where band = 'view' and frame >= 1""")
sql("band_groups", "measured cat_bounds cat_groups", """
select g.grp, g.band, g.pos, g.fit, count(*) as points, sum((m.wl >= b.lo and m.wl <= b.hi)::bigint)::bigint as core_points
from measured m join cat_bounds b on m.wl >= b.lo - 0.1e0 and m.wl <= b.hi + 0.1e0 join cat_groups g on g.band = b.band
where g.fit group by all""")

sql("shot_batch", "shots", "select shot, path from shots where o_orderstatus <> 'F' and shot between 101000 and 109000")
sql("shot_lookup", "shots", "select shot, path, n_frames from shots where shot = 100042")
FULL_BANDS = ["b692", "b684", "b668", "b650", "b630"]
for name, source in (("full_chain", "netb_int"), ("resumed_run", "netc_int")):
    sql(name, f"{source} stacks", f"select shot, frame, {R('trig_delay_s + frame * cycle_s')} as time_s, " + ", ".join(
        f"{R(f'''max(case when band = '{b}' then intensity end)''')} as {b}" for b in FULL_BANDS)
        + f" from {source} join stacks using (shot) where frame >= 1 and n_frames > 1 group by shot, frame, trig_delay_s, cycle_s")
view("run_table", "netc_int stacks", "select shot, frame, trig_delay_s + frame * cycle_s as time_s, " + ", ".join(
    f"max(case when band = '{b}' then intensity end) as {b}" for b in FULL_BANDS)
    + " from netc_int join stacks using (shot) where frame >= 1 and n_frames > 1 group by shot, frame, trig_delay_s, cycle_s")
sql("resumed_files", "run_table", """
select shot, row_number() over (partition by shot order by part, line) - 1 as number, text from (
select shot, 1 as part, frame as line, printf('%.5f', time_s) || ', ' || """ + " || ', ' || ".join(
    f"case when {b} is null then 'nan' else printf('%.6e', {b}) end" for b in sorted(FULL_BANDS)) + """ as text from run_table
union all
select shot, 0, unnest(range(0, len(h))), unnest(h) from (select shot, """ + header([
    lit("# [Parameters]"), lit("# Name = 'lines'"), "'# ShotNo = ' || shot", lit(f"# Date = '{DATE}'"), lit("#"),
    lit("# DimNo = 1"), lit("# DimName = 'Time'"), "'# DimSize = ' || n", lit("# DimUnit = 's'"), lit("#"),
    lit("# ValNo = 5"), lit("# ValName = " + ",".join(f"'{b}'" for b in sorted(FULL_BANDS))),
    lit("# ValUnit = " + ",".join(["'W/m^2'"] * 5)), lit("#"), lit("# [Comments]"),
    lit("# time = 2.75 + frameNo*0.25 (s)"), lit("#"), lit("# [Data]")]) + """ as h
  from (select shot, count(*) as n from run_table group by shot)))""")
sql("stream_shots", "sums", "select shot, frame, ord, x, counts from sums")

# What was planted is what a fit must find.
sql("band_fit_planted", "", f"""
select c_custkey::bigint as shot, 0::bigint as frame, ['b692', 'b684', 'b668', 'b650', 'b630'][c_custkey % 5 + 1] as band,
       {R('[692e0, 683.5e0, 667.4e0, 650e0, 630.2e0][c_custkey % 5 + 1] + (c_custkey % 7 - 3) * 0.02e0', 3)} as centre,
       {R('0.4e0 + 0.05e0 * (c_custkey % 9)', 3)} as sigma, {R('1e0 + c_custkey % 13', 3)} as delta, true as converged from customer""")
sql("line_center_planted", "", f"""
select s_suppkey::bigint as cal_id, o::bigint as ord, (20 + (s_suppkey + 3 * o) % 30)::bigint as px0,
       {R('20e0 + (s_suppkey + 3 * o) % 30 + 0.25e0 * (s_suppkey % 11 - 5)', 3)} as centre,
       {R('1.2e0 + 0.1e0 * ((s_suppkey + o) % 7)', 3)} as sigma, {R('50e0 + s_suppkey % 30', 3)} as area, true as converged
from supplier, range(4) t(o)""")
sql("als_planted", "", f"""
select s_suppkey::bigint as shot, 0::bigint as frame, 'flat' as band, {R('500e0 + i / 8e0')} as wl, i::bigint as seq,
       {R('(i - 19.5e0) * (s_suppkey % 4) / 5e0', 2)} as y, {R('3e0 + s_suppkey % 5 + 19.5e0 * (s_suppkey % 4) / 5e0', 2)} as baseline
from supplier, range(10, 30) t(i)""")
