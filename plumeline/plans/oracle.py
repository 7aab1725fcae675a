"""The same queries as SQL for DuckDB, over the domain tables' names."""

from __future__ import annotations

from plumeline.sources.fixtures import with_views

R2 = "CAST(6378100 AS DOUBLE) * 6378100"


def rd(value: str, name: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"round({value}, {digits}) + CAST(0 AS DOUBLE) AS {name}"


KEY = "tracer, category, itim, ilat, ilon"
#: Contributions of fluxes to observations, and of observations to the adjoint.
FORWARD = """seen AS (SELECT DISTINCT o.obsid, o.tracer FROM fx_obs o JOIN fx_footprint f ON o.obsid = f.obsid),
sums AS (SELECT f.obsid, x.category, sum(x.flux * f.sensi) AS mix FROM fx_footprint f JOIN fx_obs o ON o.obsid = f.obsid
  JOIN fx_flux x ON x.tracer = o.tracer AND x.itim = f.itim AND x.ilat = f.ilat AND x.ilon = f.ilon GROUP BY 1, 2),
mixes AS (SELECT s.obsid, c.category, coalesce(m.mix, 0) AS mix FROM seen s JOIN (SELECT DISTINCT tracer, category FROM fx_flux) c ON c.tracer = s.tracer
  LEFT JOIN sums m ON m.obsid = s.obsid AND m.category = c.category),
modelled AS (SELECT o.*, t.fg AS mix_foreground, coalesce(o.mix_background, 0) + t.fg AS mix FROM fx_obs o LEFT JOIN (SELECT obsid, sum(mix) AS fg FROM mixes GROUP BY 1) t ON t.obsid = o.obsid)"""
ADJOINT = "adjoint AS (SELECT o.tracer, f.itim, f.ilat, f.ilon, sum(o.obs * f.sensi) AS adj FROM fx_footprint f JOIN fx_obs o ON o.obsid = f.obsid GROUP BY 1, 2, 3, 4)"


#: The background at end points, between the columns of air around them.
FOUR_AXES = """p AS (SELECT particle, obsid, height, epoch_us(time) / CAST(1000000 AS DOUBLE) AS s, (lat - CAST(71 AS DOUBLE) / 2) / 5 AS y, (lon + CAST(25 AS DOUBLE) / 2) / 5 AS x FROM fx_endpoints),
c AS (SELECT *, height - first_value(height) OVER (PARTITION BY itime, ilat, ilon ORDER BY ilev) AS above FROM fx_conc4),
t AS (SELECT DISTINCT itime, epoch_us(time) / CAST(1000000 AS DOUBLE) AS s FROM fx_conc4),
e AS (SELECT p.*, a.itime AS ta, b.itime AS tb, (p.s - a.s) / (b.s - a.s) AS tw FROM p JOIN t a ON a.s <= p.s JOIN t b ON b.itime = a.itime + 1 AND (p.s < b.s OR p.s = b.s AND b.itime = (SELECT max(itime) FROM t))
  WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 9),
w AS (SELECT e.particle, e.height AS wanted, c.ilev, c.above, c.value, CASE WHEN c.itime = ta THEN 1 - tw ELSE tw END * (1 - abs(y - c.ilat)) * (1 - abs(x - c.ilon)) AS weight
  FROM e JOIN c ON c.itime IN (ta, tb) AND abs(y - c.ilat) < 1 AND abs(x - c.ilon) < 1),
k AS (SELECT particle, wanted, ilev, sum(weight * above) AS h, sum(weight * value) AS v FROM w GROUP BY 1, 2, 3),
m AS (SELECT particle, wanted, (h + lead(h) OVER (PARTITION BY particle ORDER BY ilev)) / 2 AS mid, v FROM k),
n AS (SELECT particle, any_value(wanted) AS wanted, max(mid) FILTER (mid <= wanted) AS ma, arg_max(v, mid) FILTER (mid <= wanted) AS va, min(mid) FILTER (mid > wanted) AS mb, arg_min(v, mid) FILTER (mid > wanted) AS vb FROM m WHERE mid IS NOT NULL GROUP BY 1),
at_ends AS (SELECT p.particle, p.obsid, coalesce(va + (vb - va) * (wanted - ma) / (mb - ma), va, vb) AS background FROM p LEFT JOIN n ON n.particle = p.particle)"""


def rolling(err_min: str) -> str:
    week = "RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW"
    return f"""floored AS (SELECT *, CASE WHEN err_obs <= 0 THEN {err_min} ELSE err_obs END AS err0, epoch_us(time) AS us FROM fx_obs_ts),
weighted AS (SELECT *, CASE WHEN err0 = 0 THEN NULL ELSE 1 / (err0 * err0) END AS w FROM floored),
rolled AS (SELECT *, sum(obs * w) OVER k / sum(w) OVER k AS obs_rolling, sum(mix_apri * w) OVER k / sum(w) OVER k AS mod_rolling FROM weighted
  WINDOW k AS (PARTITION BY code ORDER BY us {week})),
resid AS (SELECT *, obs - obs_rolling AS ro, mix_apri - mod_rolling AS rm FROM rolled)"""


YEARS = "(SELECT itim, CAST(year(t0) AS INT) AS year, CAST(month(t0) AS INT) AS month FROM fx_time) y"
CO2_CH4 = "flux * CASE tracer WHEN 'co2' THEN 1e-6 / (1e15 / CAST(12.011 AS DOUBLE)) ELSE 1e-9 / (1e12 / CAST(16.04 AS DOUBLE)) END * area * dt"
DENSE = f"""dense AS (SELECT c.tracer, c.category, t.itim, l.ilat, l.ilon, coalesce(x.flux, 0) AS flux FROM (SELECT DISTINCT tracer, category FROM fx_flux) c CROSS JOIN fx_time t
  CROSS JOIN fx_cell l LEFT JOIN fx_flux x ON x.tracer = c.tracer AND x.category = c.category AND x.itim = t.itim AND x.ilat = l.ilat AND x.ilon = l.ilon)"""
META = f"SELECT tracer, meta AS category, itim, ilat, ilon, sum(coeff * flux) AS flux FROM fx_flux JOIN fx_metacat_terms USING (category) GROUP BY 1, 2, 3, 4, 5"


def axis(name: str, low: float, size: float, n: int) -> str:
    return f"{name} AS (SELECT CAST(k AS INT) AS i, CAST({low} AS DOUBLE) + k * CAST({size} AS DOUBLE) AS low, CAST({low} AS DOUBLE) + (k + 1) * CAST({size} AS DOUBLE) AS high FROM (SELECT unnest(range({n})) AS k) t)"


def overlap(name: str, a: str, b: str, sine: bool) -> str:
    f = (lambda x: f"sin(radians({x}))") if sine else (lambda x: x)
    top = f"({f('least(a.high, b.high)')} - {f('greatest(a.low, b.low)')})"
    return f"{name} AS (SELECT a.i, b.i AS j, {top} / ({f('a.high')} - {f('a.low')}) AS frac FROM {a} a JOIN {b} b ON a.low < b.high AND a.high > b.low)"


def regrid(dlat: float, nlat: int, dlon: float, nlon: int) -> str:
    return ", ".join([axis("lat_a", 33, 5, 8), axis("lat_b", 33, dlat, nlat), axis("lon_a", -15, 5, 10), axis("lon_b", -15, dlon, nlon), overlap("by_lat", "lat_a", "lat_b", True), overlap("by_lon", "lon_a", "lon_b", False)])


REGRIDDED = "SELECT tracer, category, itim, y.j AS ilat, z.j AS ilon, sum(flux * y.frac * z.frac) AS flux FROM {source} x JOIN by_lat y ON y.i = x.ilat JOIN by_lon z ON z.i = x.ilon GROUP BY 1, 2, 3, 4, 5"
TIMES = """model_axis AS (SELECT itim AS i, CAST(date_diff('day', DATE '1995-01-01', CAST(t0 AS DATE)) AS DOUBLE) AS t0, date_diff('day', DATE '1995-01-01', CAST(t0 AS DATE)) + dt / 86400 AS t1 FROM fx_time),
opt_axis AS (SELECT CAST(floor(i / CAST(3 AS DOUBLE)) AS INT) AS i, min(t0) + 10 AS t0, max(t1) + 10 AS t1 FROM model_axis GROUP BY 1),
parts AS (SELECT o.i AS itim_opt, m.i AS itim_mod, (least(m.t1, o.t1) - greatest(m.t0, o.t0)) / (m.t1 - m.t0) AS part FROM model_axis m JOIN opt_axis o ON m.t0 < o.t1 AND m.t1 > o.t0),
tmap AS (SELECT itim_opt, itim_mod, part / sum(part) OVER (PARTITION BY itim_opt) AS frac FROM parts)"""
MEMBERS = """members AS (SELECT icell, CAST(floor(ilat / CAST(2 AS DOUBLE)) * 5 + floor(ilon / CAST(2 AS DOUBLE)) AS INT) AS ipos FROM fx_cell),
hmap AS (SELECT icell, ipos, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY ipos) AS frac FROM members)"""
STATE = f"""{TIMES}, {MEMBERS}, cell_flux AS (SELECT *, ilat * 10 + ilon AS icell FROM fx_flux),
state AS (SELECT tracer, category, t.itim_opt AS itime, h.ipos, sum(flux) AS state FROM cell_flux x JOIN hmap h ON h.icell = x.icell JOIN tmap t ON t.itim_mod = x.itim GROUP BY 1, 2, 3, 4)"""
POINTS = f"""{MEMBERS}, points AS (SELECT ipos, sum((lat_s + lat_n) / 2 * area) / sum(area) AS lat, sum((lon_w + lon_e) / 2 * area) / sum(area) AS lon,
  sum(land_fraction * area) / sum(area) AS land_fraction, sum(area) AS area FROM fx_cell JOIN hmap USING (icell) GROUP BY 1)"""


def distances(points: str, on: str = "a.ipos <= b.ipos") -> str:
    half = lambda c: f"sin(radians(b.{c} - a.{c}) / 2)"
    inner = f"{half('lat')} * {half('lat')} + cos(radians(a.lat)) * cos(radians(b.lat)) * {half('lon')} * {half('lon')}"
    return f"SELECT a.ipos AS i, b.ipos AS j, 12742 * asin(sqrt(least({inner}, 1))) AS distance FROM {points} a JOIN {points} b ON {on}"


CORRELATIONS = {"g": "exp(-(distance / 500) * (distance / 500))", "e": "exp(-distance / 500)", "h": "1 / (1 + distance / 500)"}
SIGMA = f"""{STATE}, {POINTS.removeprefix(MEMBERS + ', ')}, sigma AS (SELECT tracer, category, itime, ipos, abs(state) / 1000 AS sigma FROM state),
dist AS ({distances('points', 'a.ipos >= 0')}), spatial AS (SELECT i, j, exp(-distance / 500) AS corr FROM dist WHERE exp(-distance / 500) >= 1e-7),
temporal AS (SELECT a.i, b.i AS j, exp(-abs(a.i - b.i) * CAST(91 AS DOUBLE) / 60) AS corr FROM opt_axis a CROSS JOIN opt_axis b),
over_space AS (SELECT tracer, category, itime, s.i AS ipos, sum(corr * sigma) AS s FROM sigma g JOIN spatial s ON s.j = g.ipos GROUP BY 1, 2, 3, 4),
over_time AS (SELECT tracer, category, t.i AS itime, ipos, sum(corr * s) AS s FROM over_space o JOIN temporal t ON t.j = o.itime GROUP BY 1, 2, 3, 4),
total_ AS (SELECT tracer, category, sqrt(sum(g.sigma * o.s)) AS total FROM over_time o JOIN sigma g USING (tracer, category, itime, ipos) GROUP BY 1, 2)"""
SCALED = "scaled AS (SELECT obsid, mix_background - obs AS mismatch, CASE WHEN err_obs <= 0 THEN CAST(2 AS DOUBLE) ELSE err_obs END AS sigma FROM fx_obs WHERE mix_background IS NOT NULL)"
BRACKETS = """levels AS (SELECT height, value, lead(height) OVER (ORDER BY height) AS h2, lead(value) OVER (ORDER BY height) AS v2, row_number() OVER (ORDER BY height) AS k FROM fx_conc),
at_ends AS (SELECT e.particle, e.obsid, CASE WHEN e.height < l.height OR l.h2 IS NULL THEN l.value ELSE l.value + (l.v2 - l.value) * (e.height - l.height) / (l.h2 - l.height) END AS background
  FROM fx_endpoints e JOIN levels l ON (e.height >= l.height AND (e.height < l.h2 OR l.h2 IS NULL)) OR (l.k = 1 AND e.height < l.height))"""
FILE = "lower(code) || '.' || CAST(CAST(height AS BIGINT) AS VARCHAR) || 'm.' || strftime(time, '%Y-%m') || '.hdf'"

ORACLE: dict[str, str] = {
    "fwd_mix_by_category": f"WITH {FORWARD} SELECT obsid, category, {rd('mix', 'mix', 3)} FROM mixes",
    "fwd_mix_total": f"WITH {FORWARD} SELECT obsid, {rd('mix_foreground', 'mix_foreground', 3)}, {rd('mix', 'mix', 3)} FROM modelled",
    "departures": f"WITH {FORWARD} SELECT obsid, {rd('mix_foreground', 'mix_foreground', 3)}, {rd('mix - obs', 'mismatch', 3)}, err_obs AS sigma FROM modelled WHERE mix IS NOT NULL AND err_obs IS NOT NULL",
    "adjoint_flux": f"WITH {ADJOINT} SELECT tracer, itim, ilat, ilon, {rd('adj', 'adj', 3)} FROM adjoint",
    "adjoint_by_category": f"WITH {ADJOINT} SELECT tracer, category, itim, ilat, ilon, {rd('adj', 'adj', 3)} FROM adjoint JOIN (SELECT DISTINCT tracer, category FROM fx_flux) c USING (tracer)",
    "sensitivity_map": f"SELECT tracer, ilat, ilon, {rd('sum(sensi)', 'sensi', 6)} FROM fx_footprint JOIN fx_obs USING (obsid) GROUP BY 1, 2, 3",
    "adjoint_test": f"""WITH {FORWARD}, {ADJOINT}, a AS (SELECT sum(mix_foreground * obs) AS hx_y FROM modelled WHERE mix_foreground IS NOT NULL),
        b AS (SELECT sum(adj * flux) AS x_hty FROM adjoint JOIN fx_flux USING (tracer, itim, ilat, ilon))
        SELECT {rd('hx_y', 'hx_y', 1)}, {rd('x_hty', 'x_hty', 1)}, {rd('1 - hx_y / x_hty', 'difference', 8)} FROM a CROSS JOIN b""",
    "obs_flat_join": "SELECT o.obsid, o.site, o.code, s.name, s.region, s.lat, s.lon, s.alt FROM fx_obs o LEFT JOIN fx_sites s ON s.site = o.site",
    "obs_select_times": "SELECT obsid, site, strftime(time, '%Y-%m-%d') AS day FROM fx_obs WHERE time >= DATE '1995-03-01' AND time <= DATE '1996-06-30'",
    "obs_time_bounds": "SELECT strftime(min(time), '%Y-%m-%d') AS tmin, strftime(max(time), '%Y-%m-%d') AS tmax FROM fx_obs",
    "obs_select_sites": "SELECT obsid, code, obs FROM fx_obs WHERE code IN ('s03', 's07', 's11')",
    "obs_hour_window": """SELECT obsid, CAST(substr(o.code, 2, 2) AS INT) AS site, CAST(hour(time) AS INT) AS hour FROM fx_obs_ts o JOIN fx_sites s ON s.site = CAST(substr(o.code, 2, 2) AS INT)
        WHERE CASE WHEN assim_start > assim_end THEN hour(time) >= assim_start OR hour(time) <= assim_end ELSE hour(time) BETWEEN assim_start AND assim_end END""",
    "obs_complete": f"SELECT obsid, {rd('mix_background - obs', 'mismatch')}, err_obs AS sigma FROM fx_obs WHERE mix_background IS NOT NULL AND obs IS NOT NULL AND err_obs IS NOT NULL",
    "obs_with_driver": "SELECT obsid, mix_background / 4 AS dy FROM fx_obs WHERE mix_background IS NOT NULL",
    "obs_err_floor": "SELECT obsid, CASE WHEN err_obs <= 0 THEN CAST(1 AS DOUBLE) / 2 ELSE err_obs END AS err_obs FROM fx_obs",
    "obs_rolling_mean": f"WITH {rolling('CAST(0 AS DOUBLE)')} SELECT obsid, code, {rd('obs_rolling', 'obs_rolling')}, {rd('mod_rolling', 'mod_rolling')} FROM rolled",
    "obs_model_error": f"WITH {rolling('CAST(0 AS DOUBLE)')} SELECT code, {rd('stddev_pop(ro - rm)', 'sigma')} FROM resid GROUP BY 1",
    "obs_inflated_error": f"""WITH {rolling('CAST(1 AS DOUBLE) / 4')}, spread AS (SELECT code, stddev_pop(ro - rm) AS s FROM resid GROUP BY 1)
        SELECT obsid, {rd('ro', 'obs_detrended')}, {rd('rm', 'mod_detrended')}, {rd('sqrt(err0 * err0 + s * s) * 3 / 2', 'err')} FROM resid JOIN spread USING (code)""",
    "obs_constant_cols": " UNION ALL ".join(f"SELECT '{c}' AS name FROM (SELECT max(n) AS m FROM (SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n FROM fx_obs GROUP BY site) t) u WHERE m <= 1" for c in ("code", "tracer", "height", "obs", "err_obs", "mix_background")),
    "obs_split_table": "SELECT site, max(code) AS code, max(height) AS height FROM fx_obs GROUP BY 1",
    "obs_footprint_names": f"SELECT obsid, {FILE} AS footprint FROM fx_obs",
    "obs_ids": "SELECT obsid, CASE WHEN obsid % 3 <> 0 THEN code || '.' || CAST(CAST(height AS BIGINT) AS VARCHAR) || 'm.' || strftime(time, '%Y%m%d-%H%M%S') END AS fp_id FROM fx_obs",
    "obs_missing_footprint": "SELECT o.obsid, f.obsid AS footprint FROM fx_obs o LEFT JOIN (SELECT DISTINCT obsid FROM fx_footprint WHERE itim % 2 = 0) f ON f.obsid = o.obsid",
    "obs_background_merge": "SELECT obsid, CASE WHEN obsid % 4 = 0 THEN obs * 2 ELSE mix_background END AS mix_background FROM fx_obs",
    "obs_rename": "SELECT obsid, err_obs, err_obs AS err, obs, obs AS value FROM fx_obs",
    "valid_prune_sites": "SELECT site, code, name FROM fx_sites WHERE site IN (SELECT site FROM fx_obs WHERE err_obs > 0 AND mix_background IS NOT NULL)",
    "fp_file_counts": f"SELECT {FILE} AS footprint, count(*) AS n FROM fx_obs GROUP BY 1",
    "flux_resample_sum": f"SELECT tracer, category, year, ilat, ilon, {rd('sum(flux)', 'flux')} FROM fx_flux JOIN {YEARS} USING (itim) GROUP BY 1, 2, 3, 4, 5",
    "flux_resample_mean": f"SELECT tracer, category, year, ilat, ilon, {rd('avg(flux)', 'flux', 8)} FROM fx_flux JOIN {YEARS} USING (itim) GROUP BY 1, 2, 3, 4, 5",
    "flux_upsample_ffill": f"""WITH quarterly AS (SELECT tracer, category, CAST(floor(itim / CAST(3 AS DOUBLE)) * 3 AS INT) AS itim, ilat, ilon, sum(flux) AS flux FROM fx_flux GROUP BY 1, 2, 3, 4, 5), axes AS (SELECT s.*, t.itim FROM (SELECT DISTINCT tracer, category, ilat, ilon FROM quarterly) s CROSS JOIN fx_time t),
        joined AS (SELECT a.*, q.flux FROM axes a LEFT JOIN quarterly q ON q.tracer = a.tracer AND q.category = a.category AND q.ilat = a.ilat AND q.ilon = a.ilon AND q.itim = a.itim)
        SELECT {KEY}, {rd('coalesce(last_value(flux IGNORE NULLS) OVER (PARTITION BY tracer, category, ilat, ilon ORDER BY itim ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)', 'flux')} FROM joined""",
    "flux_fill_dense": f"WITH {DENSE} SELECT {KEY}, {rd('flux', 'flux')} FROM dense",
    "flux_budget_rollup": f"SELECT tracer, category, year, month, {rd('sum(flux)', 'total', 5)} FROM fx_flux JOIN {YEARS} USING (itim) GROUP BY ROLLUP (tracer, category, year, month)",
    "flux_metacat": f"SELECT {KEY}, {rd('flux', 'flux', 6)} FROM ({META}) t",
    "flux_resolve_metacats": f"""WITH places AS (SELECT tracer, itim, ilat, ilon, sum(flux) AS everything, sum(CASE category WHEN 'fossil' THEN flux WHEN 'biosphere' THEN -flux / 2 END) AS less FROM fx_flux GROUP BY 1, 2, 3, 4),
        every_ AS (SELECT category, flux FROM fx_flux UNION ALL SELECT '_all', everything FROM places UNION ALL SELECT '_less', less FROM places WHERE less IS NOT NULL)
        SELECT category, count(*) AS n, {rd('sum(flux)', 'total', 2)} FROM every_ GROUP BY 1""",
    "flux_to_extensive": f"SELECT {KEY}, {rd('flux * area * dt / 1e15', 'flux', 3)} FROM fx_flux JOIN fx_cell USING (ilat, ilon) JOIN fx_time USING (itim)",
    "flux_to_intensive": f"SELECT {KEY}, {rd('flux / area / dt * 1e18', 'flux', 4)} FROM fx_flux JOIN fx_cell USING (ilat, ilon) JOIN fx_time USING (itim)",
    "flux_in_unit": f"SELECT {KEY}, {rd(CO2_CH4, 'flux', 7)} FROM fx_flux JOIN fx_cell USING (ilat, ilon) JOIN fx_time USING (itim)",
    "flux_half_open": f"SELECT {KEY}, {rd('flux', 'flux')} FROM fx_flux WHERE itim >= 12 AND itim < 24",
    "flux_add_category": f"""SELECT tracer, category, count(*) AS n, {rd('sum(flux)', 'total', 3)} FROM (SELECT tracer, category, flux FROM fx_flux
        UNION ALL SELECT tracer, 'ocean', CAST(3 AS DOUBLE) / 2 FROM (SELECT DISTINCT tracer, itim, ilat, ilon FROM fx_flux) p) t GROUP BY 1, 2""",
    "flux_transported": f"SELECT {KEY}, {rd('flux', 'flux')} FROM fx_flux WHERE category <> 'fires'",
    "flux_bounds": "SELECT tracer, min(itim) AS first, max(itim) AS last, min(lat_s) AS lat_s, max(lat_n) AS lat_n, min(lon_w) AS lon_w, max(lon_e) AS lon_e FROM fx_flux JOIN fx_cell USING (ilat, ilon) GROUP BY 1",
    "flux_nonzero": "SELECT tracer, count(*) AS n FROM fx_flux WHERE flux <> 0 GROUP BY 1",
    "grid_cell_area": f"SELECT ilat, ilon, icell, lat_s, lon_w, {rd('area', 'area', 0)}, {rd('flux / area * 1000000', 'density')} FROM fx_cell JOIN (SELECT ilat, ilon, sum(flux) AS flux FROM fx_flux GROUP BY 1, 2) s USING (ilat, ilon)",
    "grid_overlap_lat": f"WITH {regrid(10, 4, 12.5, 4)} SELECT i, j, {rd('frac', 'frac', 9)}, {rd('flux * frac', 'part', 3)} FROM by_lat JOIN (SELECT ilat AS i, sum(flux) AS flux FROM fx_flux GROUP BY 1) s USING (i)",
    "grid_overlap_lon": f"WITH {regrid(10, 4, 12.5, 4)} SELECT i, j, {rd('frac', 'frac', 9)}, {rd('flux * frac', 'part', 3)} FROM by_lon JOIN (SELECT ilon AS i, sum(flux) AS flux FROM fx_flux GROUP BY 1) s USING (i)",
    "grid_coarsen": f"WITH {regrid(10, 4, 12.5, 4)} SELECT {KEY}, {rd('flux', 'flux', 6)} FROM ({REGRIDDED.format(source='fx_flux')}) t",
    "grid_refine": f"WITH {regrid(2.5, 16, 2.5, 20)} SELECT {KEY}, {rd('flux', 'flux', 7)} FROM ({REGRIDDED.format(source='fx_flux')}) t",
    "grid_to_quantity": f"SELECT {KEY}, {rd('flux * area / 1e9', 'flux', 3)} FROM fx_flux JOIN fx_cell USING (ilat, ilon)",
    "grid_crop": f"SELECT tracer, category, itim, ilat - 1 AS ilat, ilon - 2 AS ilon, {rd('flux', 'flux')} FROM fx_flux WHERE ilat BETWEEN 1 AND 5 AND ilon BETWEEN 2 AND 7",
    "grid_pad": f"""WITH lat AS (SELECT CAST(k AS INT) AS ilat FROM (SELECT unnest(range(11)) AS k) t), lon AS (SELECT CAST(k AS INT) AS ilon FROM (SELECT unnest(range(13)) AS k) t),
        moved_ AS (SELECT tracer, category, itim, ilat + 1 AS ilat, ilon, flux FROM fx_flux)
        SELECT c.tracer, c.category, c.itim, y.ilat, x.ilon, {rd('coalesce(m.flux, -1)', 'flux')} FROM (SELECT DISTINCT tracer, category, itim FROM moved_) c CROSS JOIN lat y CROSS JOIN lon x
        LEFT JOIN moved_ m ON m.tracer = c.tracer AND m.category = c.category AND m.itim = c.itim AND m.ilat = y.ilat AND m.ilon = x.ilon""",
    "grid_land_mask": f"""WITH {regrid(10, 4, 12.5, 4)} SELECT y.j AS ilat, z.j AS ilon, {rd('sum(land_fraction * area * y.frac * z.frac) / sum(area * y.frac * z.frac)', 'land_fraction', 9)}
        FROM fx_cell x JOIN by_lat y ON y.i = x.ilat JOIN by_lon z ON z.i = x.ilon GROUP BY 1, 2""",
    "grid_land_polygons": f"""WITH parts AS (SELECT icell, j, i, lat_s + (lat_n - lat_s) * j / CAST(4 AS DOUBLE) AS s, lat_s + (lat_n - lat_s) * (j + 1) / CAST(4 AS DOUBLE) AS n, lon_w + (lon_e - lon_w) * (i + CAST(1 AS DOUBLE) / 2) / 4 AS x
          FROM fx_cell, (SELECT unnest(range(4)) AS j) a, (SELECT unnest(range(4)) AS i) b),
        points AS (SELECT *, (s + n) / 2 AS y, sin(radians(n)) - sin(radians(s)) AS area FROM parts),
        edges AS (SELECT a.polygon, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM fx_polygons a JOIN fx_polygons b ON b.polygon = a.polygon AND b.seq = (a.seq + 1) % 4),
        crossed AS (SELECT p.icell, p.j, p.i, e.polygon, count(*) AS n FROM points p JOIN edges e ON (y1 <= y AND y < y2 OR y2 <= y AND y < y1) AND x < x1 + (y - y1) / (y2 - y1) * (x2 - x1) GROUP BY 1, 2, 3, 4),
        land AS (SELECT DISTINCT icell, j, i, CAST(1 AS DOUBLE) AS land FROM crossed WHERE n % 2 = 1)
        SELECT p.icell, {rd('sum(area * coalesce(land, 0)) / sum(area)', 'land_fraction', 9)} FROM points p LEFT JOIN land l ON l.icell = p.icell AND l.j = p.j AND l.i = p.i GROUP BY 1""",
    "map_temporal_overlap": f"WITH {TIMES} SELECT itim_opt, itim_mod, {rd('frac', 'frac', 9)} FROM tmap",
    "map_clusters": f"WITH {MEMBERS} SELECT icell, ipos, frac FROM hmap",
    "map_native_cells": "SELECT icell, row_number() OVER (ORDER BY icell) - 1 AS ipos, CAST(1 AS DOUBLE) AS frac FROM fx_cell WHERE land_fraction > 0",
    "map_coarsen": f"WITH {STATE} SELECT tracer, category, itime, ipos, {rd('state', 'state', 5)} FROM state",
    "map_distribute_time": f"WITH {STATE} SELECT tracer, category, ipos, itim_mod, {rd('sum(state * frac)', 'value', 9)} FROM state JOIN tmap ON itim_opt = itime GROUP BY 1, 2, 3, 4",
    "map_distribute_time_adj": f"WITH {STATE} SELECT tracer, category, icell, itim_opt AS itime, {rd('sum(flux * frac)', 'state', 9)} FROM cell_flux JOIN tmap ON itim_mod = itim GROUP BY 1, 2, 3, 4",
    "map_distribute_space": f"WITH {STATE} SELECT tracer, category, itime, icell, {rd('sum(state * frac)', 'value', 7)} FROM state JOIN hmap USING (ipos) GROUP BY 1, 2, 3, 4",
    "map_distribute_space_adj": f"WITH {STATE} SELECT tracer, category, itim, ipos, {rd('sum(flux * frac)', 'state', 7)} FROM cell_flux JOIN hmap USING (icell) GROUP BY 1, 2, 3, 4",
    "map_state_to_flux": f"""WITH {STATE}, more AS (SELECT tracer, category, itim_mod AS itim, icell, sum(state * t.frac * h.frac) AS flux FROM state s JOIN tmap t ON t.itim_opt = s.itime JOIN hmap h ON h.ipos = s.ipos GROUP BY 1, 2, 3, 4),
        cells AS (SELECT tracer, category, itim, icell, sum(flux) AS flux FROM (SELECT tracer, category, itim, icell, flux FROM cell_flux UNION ALL SELECT * FROM more) u GROUP BY 1, 2, 3, 4)
        SELECT tracer, category, itim, count(*) AS n, {rd('sum(flux)', 'total', 2)} FROM cells GROUP BY 1, 2, 3""",
    "map_cluster_attrs": f"WITH {POINTS} SELECT ipos, {rd('lat', 'lat')}, {rd('lon', 'lon')}, {rd('land_fraction', 'land_fraction')}, {rd('area', 'area', 0)} FROM points",
    "map_control_axes": f"WITH {TIMES}, {MEMBERS} SELECT ipos, i AS itime, t1 - t0 AS dt FROM (SELECT DISTINCT ipos FROM members) m CROSS JOIN opt_axis",
    "prior_distance": f"WITH centres AS (SELECT icell AS ipos, lat_s + CAST(5 AS DOUBLE) / 2 AS lat, lon_w + CAST(5 AS DOUBLE) / 2 AS lon FROM fx_cell) SELECT i, j, {rd('distance', 'distance', 4)} FROM ({distances('centres')}) t",
    **{f"prior_corr_{k}": f"WITH {POINTS} SELECT i, j, {rd('corr', 'corr', 9)} FROM (SELECT i, j, {f} AS corr FROM ({distances('points', 'a.ipos >= 0')}) t) u WHERE corr >= 1e-7" for k, f in CORRELATIONS.items()},
    "prior_neighbours": f"SELECT i, j, {rd('distance', 'distance', 4)} FROM ({distances('fx_positions')}) t WHERE distance <= 500",
    "prior_corr_near": f"SELECT i, j, {rd('corr', 'corr', 9)} FROM (SELECT i, j, exp(-distance / 60) AS corr FROM ({distances('fx_positions')}) t) u WHERE corr >= 1e-7",
    "prior_temporal_corr": f"WITH {TIMES} SELECT a.i, b.i AS j, {rd('exp(-abs(a.i - b.i) * CAST(91 AS DOUBLE) / 60)', 'corr', 9)} FROM opt_axis a CROSS JOIN opt_axis b",
    "prior_errors": f"SELECT {KEY}, {rd('abs(flux)', 'sigma')} FROM fx_flux",
    "prior_total_uncertainty": f"WITH {SIGMA} SELECT tracer, category, {rd('total', 'total', 5)} FROM total_",
    "prior_scale": f"WITH {SIGMA}, years AS (SELECT sum((t1 - t0) * 86400) / (CAST(1461 AS DOUBLE) / 4 * 86400) AS years FROM (SELECT DISTINCT i, t0, t1 FROM opt_axis) t) SELECT tracer, category, itime, ipos, {rd('sigma * (5 / total * years)', 'sigma', 8)} FROM sigma JOIN total_ USING (tracer, category) CROSS JOIN years",
    "cost_function": f"WITH {SCALED} SELECT {rd('sum(mismatch / sigma * (mismatch / sigma)) / 2', 'j_obs', 1)}, count(*) AS n_obs FROM scaled",
    "state_cost": f"WITH {SIGMA} SELECT {rd('sum(sigma * sigma) / 2', 'j_bg', 4)} FROM sigma",
    "gradient_norm": f"WITH {ADJOINT} SELECT {rd('sqrt(sum(adj * adj))', 'norm', 3)} FROM adjoint",
    "chi2": f"WITH {SCALED} SELECT {rd('sum(mismatch / sigma * (mismatch / sigma)) / (count(*) - 10)', 'chi2', 4)}, count(*) AS n_obs FROM scaled",
    "fp_unique": f"SELECT obsid, CAST(floor(itim / CAST(6 AS DOUBLE)) * 6 AS INT) AS itim, ilat, ilon, {rd('sum(sensi)', 'sensi', 5)} FROM fx_footprint GROUP BY 1, 2, 3, 4",
    "fp_trim": f"""WITH moved AS (SELECT obsid, itim - 3 AS itim, ilat, ilon, sensi FROM fx_footprint), near AS (SELECT * FROM (SELECT *, max(itim) OVER (PARTITION BY obsid) AS last FROM moved) t WHERE last - itim <= 1),
        whole AS (SELECT *, min(itim) OVER (PARTITION BY obsid) AS first FROM near) SELECT obsid, itim, ilat, ilon, {rd('sensi', 'sensi', 5)} FROM whole WHERE first >= 0""",
    "fp_release_fold": f"""WITH ends AS (SELECT *, max(itim) OVER (PARTITION BY obsid) AS last FROM fx_footprint)
        SELECT obsid, CASE WHEN obsid % 2 = 0 AND itim = last THEN itim - 1 ELSE itim END AS itim, ilat, ilon, {rd('sum(sensi)', 'sensi', 5)} FROM ends GROUP BY 1, 2, 3, 4""",
    "fp_unit_fix": f"SELECT obsid, itim, ilat, ilon, {rd('CASE WHEN obsid % 3 = 0 THEN sensi * CAST(0.0002897 AS DOUBLE) ELSE sensi END', 'sensi', 9)} FROM fx_footprint",
    "src_footprint_reader": f"""WITH ends AS (SELECT obsid, itim, ilat, ilon, CASE WHEN obsid % 3 = 0 THEN sensi * CAST(0.0002897 AS DOUBLE) ELSE sensi END AS sensi, max(itim) OVER (PARTITION BY obsid) AS last FROM fx_footprint),
        folded AS (SELECT obsid, CASE WHEN obsid % 2 = 0 AND itim = last THEN itim + 1 ELSE itim + 2 END AS itim, ilat, ilon, sum(sensi) AS sensi FROM ends GROUP BY 1, 2, 3, 4),
        near AS (SELECT * FROM (SELECT *, max(itim) OVER (PARTITION BY obsid) AS last FROM folded) t WHERE last - itim <= 2),
        whole AS (SELECT *, min(itim) OVER (PARTITION BY obsid) AS first FROM near) SELECT obsid, itim, ilat, ilon, {rd('sensi', 'sensi', 9)} FROM whole WHERE first >= 0""",
    "flux_as_vector": f"SELECT tracer, (CAST(itim AS BIGINT) * 8 + ilat) * 10 + ilon AS k, {rd('flux', 'flux', 5)} FROM fx_flux WHERE category = 'fires'",
    "src_cube_of_a_tracer": f"SELECT {KEY}, {rd('flux', 'flux', 5)} FROM fx_flux WHERE tracer = 'co2'",
    "fp_dense_to_coo": f"SELECT obsid, ilat, ilon, {rd('sum(sensi)', 'sensi', 5)} FROM fx_footprint GROUP BY 1, 2, 3 HAVING sum(sensi) <> 0",
    "fp_compressed_to_coo": f"SELECT obsid, CAST(1 - dense_rank() OVER (PARTITION BY obsid ORDER BY itim) AS INT) AS itim, CAST(ilon AS DOUBLE) AS lon, CAST(ilat AS DOUBLE) AS lat, {rd('sensi', 'sensi', 5)} FROM fx_footprint",
    "fp_clip": """SELECT obsid, itim, CAST(floor((CAST(71 AS DOUBLE) / 2 + 5 * ilat - 40) / (CAST(5 AS DOUBLE) / 2)) AS INT) AS jlat, CAST(floor((5 * ilon - CAST(25 AS DOUBLE) / 2) / (CAST(5 AS DOUBLE) / 2)) AS INT) AS jlon
        FROM fx_footprint WHERE CAST(71 AS DOUBLE) / 2 + 5 * ilat BETWEEN 40 AND 60 AND 5 * ilon - CAST(25 AS DOUBLE) / 2 BETWEEN 0 AND 30""",
    "fp_misaligned": "SELECT count(*) AS n, sum(CASE WHEN itim BETWEEN 0 AND 59 AND ilat BETWEEN 0 AND 7 AND ilon BETWEEN 0 AND 8 THEN 0 ELSE 1 END)::BIGINT AS n_outside FROM fx_footprint",
    "fp_catalog": "SELECT obsid, min('file' || CAST(itim % 2 AS VARCHAR) || '-' || CAST(itim AS VARCHAR)) AS footprint FROM fx_footprint GROUP BY 1",
    "bg_interp_height": f"WITH {BRACKETS} SELECT particle, {rd('background', 'background')} FROM at_ends",
    "bg_mean": f"WITH {BRACKETS} SELECT obsid, {rd('avg(background)', 'mix_background')} FROM at_ends GROUP BY 1",
    "bg_mid_height": "SELECT ilev, (height + lead(height) OVER (ORDER BY ilev)) / 2 AS mid, height - first_value(height) OVER (ORDER BY ilev) AS height_above_ground FROM fx_conc",
    "bg_multilinear": f"""WITH p AS (SELECT particle AS point, least(greatest((lat - CAST(71 AS DOUBLE) / 2) / 5, 0), 7) AS y, least(greatest((lon + CAST(25 AS DOUBLE) / 2) / 5, 0), 9) AS x FROM fx_endpoints)
        SELECT point, {rd('sum((1 - abs(y - ilat)) * (1 - abs(x - ilon)) * land_fraction)', 'value')} FROM p JOIN fx_cell ON abs(y - ilat) < 1 AND abs(x - ilon) < 1 GROUP BY 1""",
    "bg_four_axes": f"WITH {FOUR_AXES} SELECT particle, {rd('background', 'background')} FROM at_ends",
    "bg_four_axes_mean": f"WITH {FOUR_AXES} SELECT obsid, {rd('avg(background)', 'mix_background')} FROM at_ends GROUP BY 1",
    "h_bucketed_forward": f"SELECT f.obsid, {rd('sum(x.flux * f.sensi)', 'hx', 3)} FROM fx_footprint f JOIN fx_obs o ON o.obsid = f.obsid JOIN fx_flux x ON x.tracer = o.tracer AND x.itim = f.itim AND x.ilat = f.ilat AND x.ilon = f.ilon GROUP BY 1",
    "h_bucketed_adjoint": f"WITH {ADJOINT} SELECT tracer, itim, ilat, ilon, {rd('adj', 'adj', 3)} FROM adjoint",
    "archive_fallback": f"""WITH field AS (SELECT tracer, category, ilat, ilon, sum(flux) AS flux FROM fx_flux WHERE category <> 'fires' GROUP BY 1, 2, 3, 4),
        months AS (SELECT DISTINCT tracer, category, itim FROM fx_flux WHERE category = 'fossil' AND itim % 2 = 0), got AS (SELECT {KEY}, flux FROM fx_flux WHERE category = 'fires' OR category = 'fossil' AND itim % 2 = 0
        UNION ALL SELECT f.tracer, f.category, t.itim, f.ilat, f.ilon, f.flux FROM field f CROSS JOIN fx_time t ANTI JOIN months m ON m.tracer = f.tracer AND m.category = f.category AND m.itim = t.itim)
        SELECT {KEY}, {rd('flux', 'flux', 5)} FROM got""",
    "union_vectors": f"WITH {STATE} SELECT tracer, category, count(*) AS n FROM state WHERE tracer IN ('co2', 'ch4') GROUP BY 1, 2",
    "opt_anchor": """WITH p AS (SELECT CAST(min(time) AS DATE) AS a, CAST(max(time) AS DATE) AS b FROM fx_obs), q AS (SELECT a, b, make_date(year(a), 1, 1) AS january FROM p),
        s AS (SELECT b, january + CAST(7 * ceil((a - january) / CAST(7 AS DOUBLE)) AS INT) AS first FROM q), n AS (SELECT *, unnest(range(CAST(floor((b - first) / CAST(7 AS DOUBLE)) AS BIGINT))) AS k FROM s)
        SELECT k AS itime, strftime(first + CAST(7 * k AS INT), '%Y-%m-%d') AS t0, strftime(first + CAST(7 * k + 7 AS INT), '%Y-%m-%d') AS t1 FROM n""",
    "spin_axis": """WITH p AS (SELECT CAST(CAST(min(time) AS DATE) - INTERVAL 1 MONTH AS DATE) AS a, CAST(CAST(max(time) AS DATE) + INTERVAL 1 MONTH AS DATE) AS b FROM fx_obs), n AS (SELECT a, unnest(range(b - a)) AS k FROM p)
        SELECT k AS itim, strftime(a + CAST(k AS INT), '%Y-%m-%d') AS day FROM n""",
    "endpoints_time": "SELECT particle, obsid, strftime(TIMESTAMP '1995-01-01 06:00:00' + to_seconds(particle * 60), '%Y-%m-%d %H:%M:%S') AS time FROM fx_endpoints",
    "time_axis": """WITH t AS (SELECT CAST(k AS BIGINT) AS itim, make_date(1995 + CAST(floor(k / CAST(12 AS DOUBLE)) AS INT), CAST(k % 12 + 1 AS INT), 1) AS t0,
          CASE WHEN k = 12 THEN CAST(19 AS DOUBLE) ELSE CAST(day(last_day(make_date(1995, CAST(k % 12 + 1 AS INT), 1))) AS DOUBLE) END * 86400 AS dt FROM (SELECT unnest(range(13)) AS k) u),
        n AS (SELECT (year(time) - 1995) * 12 + month(time) - 1 AS itim, count(*) AS n_obs FROM fx_obs WHERE time >= TIMESTAMP '1995-01-01' AND time < TIMESTAMP '1996-01-20' GROUP BY 1)
        SELECT itim, strftime(t0, '%Y-%m-%d') AS day, dt, coalesce(n_obs, 0) AS n_obs FROM t LEFT JOIN n USING (itim)""",
    "portal_sanitize": r"""SELECT site, regexp_replace(name || ' [x]''"{é} 1.5' || region, '[^\x2D-\x7A]|[\[\]]', '', 'g') AS text FROM fx_sites""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLE.items()}
