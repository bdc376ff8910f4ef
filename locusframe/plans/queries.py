"""One query per operator over the genotype views, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import measures as M
from ..operators import diversity as DV
from ..operators import exports as X
from ..operators import filters as FI
from ..operators import isolation as I
from ..operators import loci as L
from ..operators import ordination as O
from ..operators import packed as P
from ..operators import pairs as PA
from ..operators import population as PO
from ..operators import replicates as R
from ..operators import runs as RU
from ..operators import stats as S
from ..operators import sweep as SW
from ..operators.planes import Planes
from ..sources import tables as T
from ..sources import vcf as V
from . import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PRELUDE = "with recursive calls as (%s), sites as (%s), samples as (%s), reps as (%s), runs as (%s)" % (
    FX.CALLS_SQL.format(lineitem="lineitem"), FX.SITES_SQL.format(part="part"), FX.SAMPLES_SQL.format(supplier="supplier"), FX.REPS_SQL, FX.RUNS_SQL.format(orders="orders"),
)
#: Aggregates and pairs that several oracles start from.
SP = """, sp as (select site_id, locus, pop, count(*) as n, sum(dosage) as alt, count(*) filter (dosage = 0) as x0,
  count(*) filter (dosage = 1) as x1, count(*) filter (dosage = 2) as x2 from calls group by all)"""
PAIRS = """, pairs as (select x.sample as a, y.sample as b, avg(case when x.dosage <> y.dosage then 1.0::double else 0.0::double end) as dist
  from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all)"""
PP = """, pp as (select x.pop as pop_a, y.pop as pop_b, x.n::double as n1, y.n::double as n2, x.alt::double as a1, y.alt::double as a2,
  x.x0::double as x0, x.x1::double as x1, x.x2::double as x2, y.x0::double as y0, y.x1::double as y1, y.x2::double as y2
  from sp x join sp y on x.site_id = y.site_id and x.pop < y.pop)"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a function as a query; `sql` follows the prelude of views."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = PRELUDE + sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as long: sums of doubles depend on their order."""
    out = []
    for c, t in df.dtypes:
        out.append(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c))
    return df.select(*out)


# --- the flagship, and filters of packed sites ---------------------------------------------------


@query(""", st as (select site_id, locus, count(*) as ns, sum(dosage) as n_alt, 2 * count(*) - sum(dosage) as n_ref,
  count(distinct dosage) as g, avg((dosage = 1)::int) as het from calls group by all),
ok as (select *, row_number() over (partition by locus order by ns desc, site_id) as r from st
  where ns >= 0.45 * 44 and n_alt >= 3 and n_ref >= 3 and g > 1)
select site_id, locus, ns::bigint as ns, n_ref::bigint as n_ref, n_alt::bigint as n_alt, round(least(n_alt, n_ref)::double / (2 * ns), 6) as maf,
  round(het, 6) as freq_hets from ok where r = 1""")
def filtered_single_snp(spark, d):
    """Call rate, allele counts, variation; one SNP per locus by samples called; its statistics."""
    p = FX.planes(spark, d)
    p = p.where(p.min_call_rate(0.45) & p.min_mac(3) & p.polymorphic()).with_column("ns", p.n_called())
    best = replace(p, sites=S.one_snp_per_locus(p.sites, F.col("ns")))
    return _rounded(best.sites.select("site_id", "locus", "ns", *best.site_stats()).select("site_id", "locus", "ns", "n_ref", "n_alt", "maf", "freq_hets"))


def _plane_filter(name: str, predicate: Callable[[Planes], Column], having: str) -> None:
    """A query of the ids of sites that a predicate keeps; `having` is its SQL over grouped calls."""

    def run(spark, d):
        p = FX.planes(spark, d)
        return p.sites.where(predicate(p)).select("site_id", p.n_called().cast("long").alias("n_called"))

    query(f" select site_id, count(*)::bigint as n_called from calls group by site_id having {having}", name)(run)


_plane_filter("min_call_rate", lambda p: p.min_call_rate(0.5), "count(*) >= 22")
_plane_filter("min_mac", lambda p: p.min_mac(5), "sum(dosage) >= 5 and 2 * count(*) - sum(dosage) >= 5")
_plane_filter("min_maf", lambda p: p.min_maf(0.2), "least(sum(dosage), 2 * count(*) - sum(dosage)) / (2.0 * count(*))::double >= 0.2::double")
_plane_filter("max_depth", lambda p: p.max_depth(95), "max(dp) <= 95")
_plane_filter("min_depth", lambda p: p.min_depth(4), "min(dp) >= 4")
_plane_filter("max_mean_depth", lambda p: p.max_mean_depth(27), "avg(case when dp > 0 then dp end) <= 27")
_plane_filter("min_mean_depth", lambda p: p.min_mean_depth(25), "avg(case when dp > 0 then dp end) >= 25")
_plane_filter("require_pops", lambda p: p.require_pops(FX.pops(), ["pop0", "pop3"]), "count(*) filter (pop = 'pop0') > 0 and count(*) filter (pop = 'pop3') > 0")
_plane_filter("min_per_pop", lambda p: p.min_per_pop(FX.pops(), 3), " and ".join(f"count(*) filter (pop = 'pop{i}') >= 3" for i in range(5)))
_plane_filter("min_pops", lambda p: p.min_pops(FX.pops(), 5), "count(distinct pop) >= 5")
_plane_filter("drop_monomorphic_genotypes", lambda p: p.polymorphic("genotypes"), "count(distinct dosage) > 1")
_plane_filter("drop_monomorphic_states", lambda p: p.polymorphic("all_states"), "count(distinct dosage) > 1")
_plane_filter("drop_monomorphic_alleles", lambda p: p.polymorphic("alleles"), "sum(dosage) > 0 and sum(dosage) < 2 * count(*)")
_plane_filter("filter_all_na", Planes.any_called, "count(*) > 0")
_plane_filter("drop_no_depth", Planes.any_depth, "max(dp) > 0")


@query(" select site_id, n_alleles::bigint as n_alleles from sites where n_alleles = 2")
def biallelic(spark, d):
    s = FX.sites(spark, d).withColumn("alleles", F.filter(F.array("ref", "alt", "alt2"), lambda x: x.isNotNull()))
    return s.where(P.biallelic()).select("site_id", F.size("alleles").cast("long").alias("n_alleles"))


@query(" select site_id, count(*) filter (dp between 15 and 60)::bigint as n_called from calls group by site_id")
def mask_calls_by_depth(spark, d):
    p = FX.planes(spark, d, (15, 60))
    return p.sites.select("site_id", p.n_called().cast("long").alias("n_called"))


@query(""" select site_id, count(*)::bigint as n_called from calls where sample not in ('ind1', 'ind7') group by site_id""")
def drop_samples(spark, d):
    ids = spark.createDataFrame([("ind1",), ("ind7",)], "id string")
    return FI.drop_samples(FX.calls(spark, d), ids).groupBy("site_id").agg(F.count(F.lit(1)).alias("n_called"))


@query(""" select site_id, count(*)::bigint as n_called from calls where sample in ('ind1', 'ind7', 'ind9') group by site_id having count(distinct dosage) > 1""")
def keep_samples(spark, d):
    """Listed samples only; sites that vary among them."""
    p = FX.planes(spark, d).keep([1, 7, 9])
    return p.sites.where(p.polymorphic()).select("site_id", p.n_called().cast("long").alias("n_called"))


@query(""", n as (select count(distinct site_id) as t from calls),
s as (select sample_idx, count(*) as n from calls group by sample_idx),
k as (select sample_idx from s, n where 1 - n.t::double * 0 - s.n::double / n.t < 0.48)
select site_id, count(*)::bigint as n_called from calls where sample_idx in (select sample_idx from k) group by site_id""")
def drop_samples_by_missing(spark, d):
    p, _ = FI.drop_samples_by_missing(FX.planes(spark, d), FX.names(), 0.48)
    return p.sites.where(p.any_called()).select("site_id", p.n_called().cast("long").alias("n_called"))


def _in_turn(site_steps: tuple, sample_steps: tuple, max_missing: float, min_coverage: float) -> str:
    """The filters in turn as a chain of steps: sites s1, s2, ... and samples k1, k2, ..."""
    steps = ["s0 as (select distinct site_id from calls), k0 as (select unnest(range(44)) as i)"]
    site = "s{n} as materialized (select s.site_id from s{p} s left join (select c.site_id, count(*) as n from calls c join k{q} k on k.i = c.sample_idx group by c.site_id) h on h.site_id = s.site_id where coalesce(n, 0) >= {v} * (select count(*) from k{q}))"
    person = "k{n} as materialized (select k.i from k{p} k left join (select sample_idx, count(*) as n from calls where site_id in (select site_id from s{q}) group by sample_idx) h on h.sample_idx = k.i where 1 - coalesce(n, 0)::double / (select count(*) from s{q}) < {v})"
    n = len(site_steps)
    for i, (rate, limit) in enumerate(zip(site_steps, sample_steps)):
        steps += [site.format(n=i + 1, p=i, q=i, v=rate), person.format(n=i + 1, p=i, q=i + 1, v=limit)]
    steps += [person.format(n=n + 1, p=n, q=n, v=max_missing), site.format(n=n + 1, p=n, q=n + 1, v=min_coverage)]
    return ", " + ",\n".join(steps) + f""" select s.site_id, count(k.i)::bigint as n_called, (select count(*) from k{n + 1})::bigint as n_samples
from s{n + 1} s left join calls c on c.site_id = s.site_id left join k{n + 1} k on k.i = c.sample_idx group by s.site_id"""


@query(_in_turn((0.2, 0.3, 0.4, 0.45), (0.9, 0.7, 0.6, 0.55), 0.52, 0.5))
def iterative_filter(spark, d):
    sites, names = FI.iterative_filter(FX.packed_sites(spark, d), FX.names(), (0.2, 0.3, 0.4, 0.45), (0.9, 0.7, 0.6, 0.55), 0.52, 0.5)
    return sites.select("site_id", P.n_called().cast("long").alias("n_called"), F.lit(len(names)).cast("long").alias("n_samples"))


@query(""", deep as (select site_id from calls group by site_id having avg(case when dp > 0 then dp end) >= 10),
m as materialized (select * from calls where site_id in (select site_id from deep) and dp between 6 and 500),
s as materialized (select site_id from m group by site_id having sum(dosage) >= 3 and 2 * count(*) - sum(dosage) >= 3 and count(*) / 44.0::double >= 0.4),
k as materialized (select range as i from range(44) left join (select sample_idx, count(*) as n from m where site_id in (select site_id from s) group by sample_idx) h on h.sample_idx = range
  where 1 - coalesce(n, 0)::double / (select count(*) from s) < 0.65)
select s.site_id, count(k.i)::bigint as n_called, (select count(*) from k)::bigint as n_samples from s left join m on m.site_id = s.site_id left join k on k.i = m.sample_idx group by s.site_id""")
def strict_filter(spark, d):
    p, names = FI.strict_filter_calls(FX.calls(spark, d), FX.names(), True, 0.4, 0.65, (6, 500), 10, 3, unique=True)
    return p.sites.select("site_id", p.n_called().cast("long").alias("n_called"), F.lit(len(names)).cast("long").alias("n_samples"))


@query(""" select site_id, count(*)::bigint as n_called from calls where pop not in ('pop1') and not contains(sample, '3') group by site_id""")
def drop_pops(spark, d):
    return FI.drop_outgroups(FI.drop_pops(FX.calls(spark, d), ["pop1"]), "3").groupBy("site_id").agg(F.count(F.lit(1)).alias("n_called"))


@query(""" select sample, count(*)::bigint as n from calls where regexp_matches(pop, '[23]$') group by sample""")
def keep_pops_like(spark, d):
    return FI.keep_pops_like(FX.calls(spark, d), "[23]$").groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@query(""", g as (select site_id, dosage, count(distinct pop) as p from calls group by all)
select site_id from g group by site_id having count(*) > 2 or (count(*) = 2 and min(p) >= 2)""")
def drop_autapomorphic(spark, d):
    return FI.drop_autapomorphic(FX.calls(spark, d))


@query(SP + """ select site_id from sp group by site_id having count(*) filter (alt / (2.0 * n) > 1e-4 and alt / (2.0 * n) < 0.99) <> 1""")
def drop_single_pop_polymorphisms(spark, d):
    return FI.drop_single_pop_polymorphisms(PO.allele_freq(PO.site_pop(FX.calls(spark, d))))


@query(""", z as (select pop, count(*) as size from samples group by pop),
h as (select pop, site_id, count(*) as n from calls where sample in (select sample from samples) group by all)
select h.pop, site_id from h join z on h.pop = z.pop where n = size""")
def complete_sites_in_pop(spark, d):
    few = FX.samples(spark, d)
    return FI.complete_sites_in_pop(FX.calls(spark, d), few)


TAGS = ", t0 as (%s), tags as (select locus, string_agg(base, '' order by i) as seq from t0 group by locus)" % FX.TAGS_SQL.format(part="part")


@query(TAGS + " select locus, length(seq)::bigint as n from tags where length(seq) between 65 and 69")
def filter_taglength(spark, d):
    return FI.filter_taglength(FX.tags(spark, d)).select("locus", F.length("seq").cast("long").alias("n"))


@query(TAGS + """ select locus from tags t where not exists (select 1 from tags f where f.locus < t.locus
  and hamming(substr(f.seq, 6), substr(t.seq, 6)) <= 9)""")
def filter_hamming(spark, d):
    """Each tag judged on the input."""
    return FI.filter_hamming(FX.tags(spark, d), rule="input").select("locus")


@query(TAGS + """, o as (select locus, substr(seq, 6) as seq, row_number() over (order by locus % 7 desc, locus) as i from tags),
g(i, kept, loci) as (select 0, []::varchar[], []::bigint[] union all
  select o.i, case when len(list_filter(kept, lambda k: hamming(k, o.seq) <= 9)) = 0 then list_append(kept, o.seq) else kept end,
    case when len(list_filter(kept, lambda k: hamming(k, o.seq) <= 9)) = 0 then list_append(loci, o.locus) else loci end from g join o on o.i = g.i + 1)
select unnest(loci) as locus from g where i = (select max(i) from o)""")
def filter_hamming_in_order(spark, d):
    """Tags in the order of a reproducibility; one goes if a tag that is kept is near."""
    return FI.filter_hamming(FX.tags(spark, d).withColumn("rep_avg", (F.col("locus") % 7).cast("double"))).select("locus")


@query(""", l as (select distinct locus, sample from calls where locus % 3 = 0 and sample <> 'ind2')
select locus, count(*)::bigint as samples from l group by locus having count(*) >= 35""")
def select_loci(spark, d):
    seqs = FX.sequences(spark, d)
    ids = FX.sites(spark, d).where("locus % 3 = 0").select(F.col("locus").alias("id")).distinct()
    kept = FI.select_loci(seqs, ids, spark.createDataFrame([("ind2",)], "id string"), 35)
    return kept.groupBy("locus").agg(F.count(F.lit(1)).alias("samples"))


# --- statistics ----------------------------------------------------------------------------------


@query(""" select site_id, count(*)::bigint as n_called, round(count(*) / 44.0::double, 6) as call_rate, (2 * count(*) - sum(dosage))::bigint as n_ref, sum(dosage)::bigint as n_alt,
  round(least(sum(dosage), 2 * count(*) - sum(dosage)) / (2.0 * count(*))::double, 6) as maf, round(avg((dosage = 1)::int), 6) as freq_hets,
  round(avg((dosage = 0)::int), 6) as freq_hom_ref, round(avg((dosage = 2)::int), 6) as freq_hom_snp, round(avg(dp), 1) as mean_depth from calls group by site_id""")
def site_stats(spark, d):
    p = FX.planes(spark, d)
    return _rounded(p.sites.select("site_id", *p.site_stats()))


@query(""" select site_id, count(*)::bigint as n_called, sum(dosage)::bigint as n_alt, round(avg((dosage = 1)::int), 6) as freq_hets from calls group by site_id""")
def call_stats(spark, d):
    return _rounded(S.call_stats(FX.calls(spark, d)))


@query(""", t as (select count(distinct site_id) as t from calls), h as (select sample, count(*) as n from calls group by sample)
select s.sample, s.pop, round(100 * (1 - coalesce(n, 0)::double / t), 6) as missing_percent from samples s left join h on s.sample = h.sample, t""")
def sample_missing(spark, d):
    return _rounded(S.sample_missing(FX.calls(spark, d), FX.samples(spark, d)))


@query(""", t as (select count(distinct site_id) as t from calls), h as (select sample, count(*) as n from calls group by sample),
m as (select s.sample, s.pop, 100 * (1 - coalesce(n, 0)::double / t) as x from samples s left join h on s.sample = h.sample, t)
select pop, round(min(x), 6) as min, round(quantile_cont(x, 0.25), 6) as q1, round(quantile_cont(x, 0.5), 6) as median, round(avg(x), 6) as mean,
  round(quantile_cont(x, 0.75), 6) as q3, round(max(x), 6) as max from m group by pop""")
def missing_summary_by_pop(spark, d):
    return _rounded(S.summary(S.sample_missing(FX.calls(spark, d), FX.samples(spark, d)), "missing_percent", "pop"))


@query(" select site_id, round(1 - count(*) / 44.0::double, 6) as f_miss, round(avg(dp), 6) as mean_depth from calls group by site_id")
def site_missing(spark, d):
    return _rounded(S.site_missing(FX.calls(spark, d), FX.N_SAMPLES))


@query(" select sample, count(*)::bigint as n_sites, round(avg(dp), 6) as mean_depth from calls group by sample")
def sample_depth(spark, d):
    return _rounded(S.sample_depth(FX.calls(spark, d)))


@query(""", s as (select site_id, count(*) as n, sum(dosage) / (2.0 * count(*))::double as p from calls group by site_id),
e as (select site_id, 1 - 2 * p * (1 - p) * 2 * n / (2 * n - 1) as e from s where p > 0 and p < 1)
select sample, count(*) filter (dosage <> 1)::bigint as o_hom, round(sum(e), 6) as e_hom, count(*)::bigint as n,
  round((count(*) filter (dosage <> 1) - sum(e)) / (count(*) - sum(e)), 6) as f from calls join e on calls.site_id = e.site_id group by sample""")
def sample_inbreeding_f(spark, d):
    return _rounded(S.inbreeding_f(FX.calls(spark, d)))


@query(""", s as (select site_id, avg(case when dp > 0 then dp end) as m, max(dp) as most from calls group by site_id)
select count(m)::bigint as sites_with_depth, count(*) filter (m is null)::bigint as sites_without, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd,
  round(min(m), 6) as least, round(max(m), 6) as greatest, max(most)::bigint as max_depth, round(sum(round_even(m, 0)), 6) as rounded_total from s""")
def depth_report(spark, d):
    return _rounded(S.depth_report(FX.calls(spark, d)))


@query(" select sample, round(avg(dp), 6) as mean_depth from calls where dp > 0 group by sample")
def depth_by_sample(spark, d):
    return _rounded(S.depth_by_sample(FX.calls(spark, d)))


@query(""", s as (select site_id, avg(case when dp > 0 then dp end) as m from calls group by site_id), t as (select least(max(m), 40.0::double) as top from s)
select least(floor(m / (top / 8)), 7)::bigint as bin, count(*)::bigint as n from s, t where m <= top group by 1""")
def depth_histogram(spark, d):
    return _rounded(S.depth_histogram(FX.calls(spark, d), 40))


@query(""", s as (select site_id, locus from calls group by all having count(*) >= 0.55 * 44) select count(*)::bigint as snps, count(distinct locus)::bigint as loci from s""")
def coverage_counts(spark, d):
    return S.coverage_counts(FX.calls(spark, d), FX.N_SAMPLES, 0.55)


PARIS = ", n as (select {k} count(*) as size from samples {g}), s as (select {k} site_id, locus, count(*) as n, min(dosage) as lo, max(dosage) as hi from calls where sample in (select sample from samples) group by all)"


@query(PARIS.format(k="", g="") + " select count(distinct locus)::bigint as loci from s, n where lo <> hi and s.n >= 0.55 * size")
def paris80(spark, d):
    return S.paris80(FX.calls(spark, d), FX.samples(spark, d), share=0.55)


@query(PARIS.format(k="pop,", g="group by pop") + " select s.pop, count(distinct locus)::bigint as loci from s join n on s.pop = n.pop where size >= 5 and lo <> hi and s.n >= 0.7 * size group by s.pop")
def paris80_by_pop(spark, d):
    return S.paris80(FX.calls(spark, d), FX.samples(spark, d), True, 0.7)


@query(" select sample, round(avg((dosage = 1)::int), 6) as het from calls group by sample")
def snp_heterozygosity(spark, d):
    return _rounded(S.snp_heterozygosity(FX.calls(spark, d)))


@query(" select sample, round(avg((dosage = 1)::int), 6) as het from calls group by sample")
def sequence_heterozygosity(spark, d):
    return _rounded(S.sequence_heterozygosity(FX.sequences(spark, d)))


@query(", l as (select locus, count(distinct site_id) as snps from calls group by locus) select snps::bigint as snps, count(*)::bigint as loci from l group by snps")
def secondaries_report(spark, d):
    return _rounded(S.secondaries_report(FX.calls(spark, d)))


@query(" select pop, count(distinct locus)::bigint as loci, count(distinct site_id)::bigint as snps, count(distinct sample)::bigint as samples from calls group by pop")
def dataset_size(spark, d):
    return S.dataset_size(FX.calls(spark, d), "pop")


@query(TAGS + " select count(*)::bigint as n, round(avg(length(seq)), 6) as mean, min(length(seq))::bigint as least, max(length(seq))::bigint as greatest, round(stddev_pop(length(seq)), 6) as sd from tags")
def locus_length_stats(spark, d):
    return _rounded(S.locus_length_stats(FX.tags(spark, d)))


@query(" select distinct concat(least(a1, a2)::varchar, greatest(a1, a2)::varchar) as code from calls")
def genotype_codes(spark, d):
    return S.genotype_codes(FX.calls(spark, d))


@query(""", s as (select site_id, locus, count(*) as ns from calls group by all)
select site_id, locus, ns::bigint as ns from (select *, row_number() over (partition by locus order by ns desc, site_id) as r from s) where r = 1""")
def one_snp_per_locus(spark, d):
    return S.one_snp_per_locus(FX.calls(spark, d).groupBy("site_id", "locus").agg(F.count(F.lit(1)).alias("ns")), F.col("ns"))


@query(""" select site_id, locus, key::bigint as key from (select site_id, locus, (site_id * 7919) % 10007 as key,
  row_number() over (partition by locus order by (site_id * 7919) % 10007 desc, site_id) as r from sites) where r = 1""")
def random_snp_per_locus(spark, d):
    s = FX.sites(spark, d).select("site_id", "locus", ((F.col("site_id") * 7919) % 10007).alias("key"))
    return S.one_snp_per_locus(s, F.col("key"))


@query(" select sample, pop from (select *, row_number() over (partition by pop order by (sample_idx * 31) % 17, sample) as r from samples) where r <= 3")
def random_per_pop(spark, d):
    return S.random_per_pop(FX.samples(spark, d), 3, (F.col("sample_idx") * 31) % 17).select("sample", "pop")


@query(" select site_id from sites order by (site_id * 7919) % 10007, site_id limit 100")
def downsample(spark, d):
    return S.downsample(FX.sites(spark, d), 100, (F.col("site_id") * 7919) % 10007).select("site_id")


@query(" select site_id, (row_number() over (order by site_id) - 1)::bigint as site_idx from sites")
def site_index(spark, d):
    return S.with_site_index(FX.sites(spark, d).select("site_id"), "site_id").select("site_id", F.col("site_idx").cast("long"))


# --- replicates and clones -----------------------------------------------------------------------

PAIRED = """, j as (select r.sample_a, r.sample_b, c.locus, c.site_id, max(case when c.sample = r.sample_a then dosage end) as da, max(case when c.sample = r.sample_b then dosage end) as db
  from calls c join reps r on c.sample = r.sample_a or c.sample = r.sample_b group by all)"""


@query(PAIRED + """, l as (select sample_a, sample_b, locus, bool_or(da is not null) as ia, bool_or(db is not null) as ib, bool_or(da is distinct from db) as df,
  count(*) filter (da is not null and db is not null) as nb, count(*) filter (da <> db) as nd from j group by all)
select sample_a, sample_b, round(100.0::double * count(*) filter (not (ia and ib)) / count(*), 6) as locus_error,
  round(100.0::double * count(*) filter (ia and ib and df) / count(*) filter (ia and ib), 6) as allele_error, round(100.0::double * sum(nd) / sum(nb), 6) as snp_error from l group by all""")
def replicate_errors(spark, d):
    return _rounded(R.replicate_errors(FX.calls(spark, d), FX.reps(spark)))


@query(PAIRED + """, w as (select site_id, count(*) filter (da is distinct from db) as d from j group by site_id)
select s.site_id, round(1 - coalesce(d, 0) / 4.0::double, 6) as rep_avg from (select distinct site_id from calls) s left join w on s.site_id = w.site_id""")
def reproducibility(spark, d):
    return _rounded(R.reproducibility(FX.calls(spark, d), FX.reps(spark), 4))


@query(PAIRED + """, w as (select site_id, count(*) filter (da is distinct from db) as d from j group by site_id)
select s.site_id from (select distinct site_id from calls) s left join w on s.site_id = w.site_id where 1 - coalesce(d, 0) / 4.0 >= 0.75""")
def filter_reproducibility(spark, d):
    return R.reproducibility(FX.calls(spark, d), FX.reps(spark), 4).where("rep_avg >= 0.75").select("site_id")


@query(PAIRED + """, l as (select sample_a, sample_b, locus, bool_or(da is not null) as ia, bool_or(db is not null) as ib from j group by all)
select sample_a, sample_b, count(*) filter (ia and not ib)::bigint as only_a, count(*) filter (ib and not ia)::bigint as only_b, count(*) filter (ia and ib)::bigint as both from l group by all""")
def loci_overlap(spark, d):
    return R.loci_overlap(FX.calls(spark, d), FX.reps(spark))


REPD = PAIRS + ", rp as (select p.* from pairs p join reps r on (p.a = r.sample_a and p.b = r.sample_b) or (p.a = r.sample_b and p.b = r.sample_a))"


@query(REPD + """ select round(avg(dist), 6) as mean, round(min(dist), 6) as least, round(max(dist), 6) as greatest, round(2 * avg(dist), 6) as double_mean,
  round(avg(dist) + 2 * stddev_pop(dist), 6) as two_sd, round(quantile_cont(dist, 0.75) + 1.5 * (quantile_cont(dist, 0.75) - quantile_cont(dist, 0.25)), 6) as outlier from rp""")
def rep_distance_thresholds(spark, d):
    return _rounded(R.rep_distance_thresholds(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()), FX.reps(spark)))


CLASSES = PAIRS + """, c as (select least(a, b) as a, greatest(a, b) as b, dist, case when exists (select 1 from reps where (a = sample_a and b = sample_b) or (a = sample_b and b = sample_a))
  then case when dist > 0.05 then 'rep_above' else 'rep_ok' end
  when dist < 0.5 and a in (select sample_a from reps union select sample_b from reps) and b in (select sample_a from reps union select sample_b from reps) then 'rep_below'
  when dist < {t} then 'possible_clone' else 'high' end as class from pairs)"""


@query(CLASSES.format(t="0.05").replace("0.5 and", "0.05 and") + " select class, count(*)::bigint as n, round(min(dist), 6) as least, round(max(dist), 6) as greatest from c group by class")
def clone_report(spark, d):
    return _rounded(R.clone_report(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()), FX.reps(spark), 0.05))


@query(CLASSES.format(t="0.05").replace("0.5 and", "0.05 and") + " select a, b, round(dist, 6) as dist, class from c")
def classify_pairs(spark, d):
    return _rounded(R.classify_pairs(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()), FX.reps(spark), 0.05))


@query(CLASSES.format(t="0.05").replace("0.5 and", "0.05 and") + " select a, b, round(dist, 6) as dist, class from c where class = 'high' order by c.dist, a, b limit 5")
def lowest_high(spark, d):
    return _rounded(R.lowest(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()), FX.reps(spark), 0.05))


@query(PAIRS + """, e as (select a, b from pairs where dist < 0.42 union select b, a from pairs where dist < 0.42),
reach(x, y) as (select a, a from e union select reach.x, e.b from reach join e on reach.y = e.a)
select x as sample, min(y) as clone_group from reach group by x""")
def clone_groups(spark, d):
    return PA.clone_groups(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()), 0.42)


# --- pairs of samples ----------------------------------------------------------------------------


@query(PAIRS + " select a, b, round(dist, 6) as dist from pairs")
def genotype_mismatch(spark, d):
    return _rounded(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()))


@query(PAIRS + """, q as (select x.sample as a, y.sample as b, count(*) as s, sum(abs(x.dosage - y.dosage)) as ad, sum((x.dosage - y.dosage) ** 2) as sq
  from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all),
o as (select sample, count(*) as n from calls group by sample), t as (select count(distinct site_id) as m from calls)
select q.a, q.b, round(pairs.dist, 6) as mismatch, round(ad / (2.0 * s)::double, 6) as divergence, round(1 - ad / (2.0 * s)::double, 6) as ibs,
  round((x.n + y.n - 2 * s)::double / (x.n + y.n - s), 6) as missing, round(sqrt(sq::double * m / s), 6) as euclidean
from q join pairs on q.a = pairs.a and q.b = pairs.b join o x on x.sample = q.a join o y on y.sample = q.b, t""")
def block_distances(spark, d):
    """All distances at once by matrix blocks."""
    return _rounded(PA.call_distances(FX.calls(spark, d), FX.names(), "mismatch", "divergence", "ibs", "missing", "euclidean"))


@query(""" select x.sample as a, y.sample as b, count(*)::bigint as shared, round(sum(abs(x.dosage - y.dosage)) / (2.0 * count(*))::double, 6) as divergence,
  round(1 - sum(abs(x.dosage - y.dosage)) / (2.0 * count(*))::double, 6) as ibs from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all""")
def dosage_divergence(spark, d):
    return _rounded(PA.dosage_divergence(FX.calls(spark, d), FX.names()))


@query(""", q as (select sum(abs(x.dosage - y.dosage)) / (2.0 * count(*))::double as v from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by x.sample, y.sample)
select round(avg(v), 6) as mean, round(max(v) / 2, 4) as height from q""")
def divergence_summary(spark, d):
    return _rounded(PA.divergence_summary(PA.dosage_divergence(FX.calls(spark, d), FX.names())))


@query(""" select x.sample as a, y.sample as b, round(sqrt(sum((x.dosage - y.dosage) ** 2)::double * (select count(distinct site_id) from calls) / count(*)), 6) as dist
  from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all""")
def euclidean(spark, d):
    return _rounded(PA.euclidean(FX.calls(spark, d), names=FX.names()))


@query(""", o as (select sample, count(*) as n from calls group by sample),
q as (select x.sample as a, y.sample as b, count(*) as s from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all)
select a, b, round((x.n + y.n - 2 * s)::double / (x.n + y.n - s), 6) as dist from q join o x on x.sample = a join o y on y.sample = b""")
def missing_mismatch(spark, d):
    return _rounded(PA.missing_mismatch(FX.calls(spark, d), FX.names()))


POFAD = "avg(1 - (case when x.dosage = y.dosage then case when x.dosage = 1 then 2 else 1 end when x.dosage = 1 or y.dosage = 1 then 1 else 0 end)::double / (case when x.dosage = 1 or y.dosage = 1 then 2 else 1 end))"


@query(f" select x.sample as a, y.sample as b, round({POFAD}, 6) as dist from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all")
def genpofad(spark, d):
    return _rounded(PA.allele_set_distance(FX.calls(spark, d), names=FX.names()))


MATCHES = "avg(case when x.dosage = y.dosage then 0.0::double when x.dosage = 1 or y.dosage = 1 then 0.25::double else 1.0::double end)"
BY_LOCUS = """, l as (select x.locus, x.sample as a, y.sample as b, {v} as v from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all)
select a, b, round(avg(v), 10) as dist, count(*)::bigint as loci from l group by all"""


@query(f" select x.sample as a, y.sample as b, round({MATCHES}, 6) as dist from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all")
def matchstates(spark, d):
    return _rounded(PA.allele_set_distance(FX.calls(spark, d), kind=PA.MATCHSTATES, names=FX.names()))


@query(BY_LOCUS.format(v=POFAD))
def locus_averaged_distance(spark, d):
    return _rounded(PA.locus_averaged(FX.calls(spark, d), names=FX.names()), 10)


@query(BY_LOCUS.format(v=MATCHES))
def locus_averaged_matchstates(spark, d):
    return _rounded(PA.locus_averaged(FX.calls(spark, d), "matchstates", FX.names()), 10)


@query(""", size as (select locus, count(distinct site_id) as sites from calls group by locus),
l as (select x.locus, x.sample as a, y.sample as b, sqrt(sum((x.dosage - y.dosage) ** 2)::double * any_value(sites) / count(*)) as v
  from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx join size on size.locus = x.locus group by all)
select a, b, round(avg(v), 10) as dist, count(*)::bigint as loci from l group by all""")
def locus_averaged_euclidean(spark, d):
    return _rounded(PA.locus_averaged(FX.calls(spark, d), "euclidean", FX.names()), 10)


@query(PAIRS + """, j as (select least(x.pop, y.pop) as pop_a, greatest(x.pop, y.pop) as pop_b, dist from pairs join samples x on x.sample = a join samples y on y.sample = b),
z as (select pop, count(*) as size from samples group by pop)
select pop_a, pop_b, count(*)::bigint as n, round(min(dist), 6) as least, round(avg(dist), 6) as mean, round(max(dist), 6) as greatest
from j join z on pop = pop_a where pop_a <> pop_b or size >= 3 group by all""")
def mean_by_pop_pairs(spark, d):
    return _rounded(PA.mean_by_pop_pairs(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()), FX.samples(spark, d)))


@query(PAIRS + " select a, b, round(dist, 6) as dist from pairs union all select b, a, round(dist, 6) from pairs")
def symmetrise(spark, d):
    return _rounded(PA.symmetrise(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names())))


@query(PAIRS + " select concat(a, chr(9), b, chr(9), printf('%.8f', dist)) as value from pairs")
def pair_lines(spark, d):
    return T.pair_lines(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()))


@query(PAIRS + ", s as (select a, b, dist from pairs union all select b, a, dist from pairs) select a, " + ", ".join(f"round(max(dist) filter (b = '{x}'), 6) as {x}" for x in FX.names()) + " from s group by a")
def distance_matrix(spark, d):
    return _rounded(T.to_matrix(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()), FX.names()))


# --- populations ---------------------------------------------------------------------------------


@query(SP + " select site_id, locus, pop, round(alt::double / (2 * n), 6) as freq from sp")
def allele_freq(spark, d):
    return _rounded(PO.allele_freq(PO.site_pop(FX.calls(spark, d))))


NEI = SP + """, h as (select *, x1::double / n as ho, alt::double / (2 * n) as p from sp),
e as (select *, case when n > 1 then n::double / (n - 1) * (1 - (p * p + (1 - p) * (1 - p)) - ho / (2 * n)) end as hs from h),
nei as (select *, case when abs(hs) > 1e-12 then 1 - ho / hs end as fis from e)"""


@query(NEI + """, z as (select pop, count(*) as samples from samples group by pop)
select nei.pop, count(*)::bigint as snps, round(avg(ho), 6) as ho, round(sqrt(var_samp(ho) / count(ho)), 6) as ho_se, round(avg(hs), 6) as hs, round(sqrt(var_samp(hs) / count(hs)), 6) as hs_se,
  round(avg(fis), 6) as fis, round(sqrt(var_samp(fis) / count(fis)), 6) as fis_se, any_value(samples)::bigint as samples,
  round(100 * (1 - sum(n)::double / (any_value(samples) * (select count(distinct site_id) from calls))), 6) as missing_percent from nei join z on nei.pop = z.pop group by nei.pop""")
def basic_stats(spark, d):
    """Diversity table of populations."""
    calls = FX.calls(spark, d)
    return _rounded(PO.basic_stats(PO.site_pop(calls), FX.samples(spark, d), calls.agg(F.countDistinct("site_id").alias("n")).first()["n"]))


@query(SP + " select site_id, locus, pop, round(1 - (alt * (alt - 1) + (2 * n - alt) * (2 * n - alt - 1))::double / (2 * n * (2 * n - 1)), 6) as gd from sp")
def gene_diversity_normal(spark, d):
    return _rounded(PO.gene_diversity_normal(PO.site_pop(FX.calls(spark, d))))


@query(SP + """ select site_id, locus, pop, round(case when n > 1 then (2 * n)::double / (2 * n - 2) * (1 - ((alt::double / (2 * n)) ** 2 + (1 - alt::double / (2 * n)) ** 2)
  - (1 - 2 * (x0 + x2)::double / (2 * n)) / (2 * n)) end, 6) as gd from sp""")
def gene_diversity_inbred(spark, d):
    return _rounded(PO.gene_diversity_inbred(PO.site_pop(FX.calls(spark, d))))


@query(""", few as (select sample, concat('grp', sample_idx % 15) as pop from samples), z as (select pop, count(*) as size from few group by pop),
own as (select c.* replace (few.pop as pop) from calls c join few on c.sample = few.sample),
f0 as (select pop, site_id, count(*) as n from own group by pop, site_id),
f as (select f0.pop, site_id from f0 join z on z.pop = f0.pop where n = size),
k as (select c.* from own c join f on c.pop = f.pop and c.site_id = f.site_id),
s as (select pop, locus, site_id, count(*) as n, avg((dosage = 1)::int) as ho, sum(dosage)::double / (2 * count(*)) as p from k group by all),
g as (select pop, count(distinct locus) as loci, count(*) as snps, count(*) filter (p > 0 and p < 1) as variable, avg(ho) as ho, avg(2 * p * (1 - p)) as he,
  avg(ho) filter (p > 0 and p < 1) as hs, avg(2 * p * (1 - p) * 2 * n / (2 * n - 1)) filter (p > 0 and p < 1) as us from s group by pop),
a as (select count(distinct locus) as l from own)
select pop, loci::bigint as loci, snps::bigint as snps, variable::bigint as variable, round(ho * snps / (snps + loci::double / l * 300), 6) as ho_auto, round(he * snps / (snps + loci::double / l * 300), 6) as he_auto,
  round(hs, 6) as ho_snp, round(us, 6) as uhe_snp, round(1 - hs / us, 6) as fis from g, a""")
def autosomal_heterozygosity(spark, d):
    """All samples, in groups small enough to have sites without a missing call."""
    group = F.concat(F.lit("grp"), (F.col("sample_idx") % 15).cast("string"))
    return _rounded(PO.autosomal_heterozygosity(FX.calls(spark, d).withColumn("pop", group), FX.samples(spark, d).withColumn("pop", group), 300))


@query(""", few as (select sample, sample_idx % 15 as g from samples), z as (select g, case when g < 8 then 'A' else 'B' end as taxon, count(*) as size from few group by g),
own as (select c.site_id, c.locus, c.dosage, few.g, taxon from calls c join few on c.sample = few.sample join z on z.g = few.g),
v as (select taxon, site_id from own group by all having sum(dosage) > 0 and sum(dosage) < 2 * count(*)),
s as (select g, taxon, locus, site_id, count(*) as n, avg((dosage = 1)::int) as ho, sum(dosage)::double / (2 * count(*)) as p from own semi join v using (taxon, site_id) group by all),
a as (select taxon, count(distinct locus) as l, case taxon when 'A' then 300 else 200 end as inv from s group by taxon),
f as (select s.*, 2 * p * (1 - p) as he, 2 * p * (1 - p) * 2 * n / (2 * n - 1) as uhe from s join z using (g) where n = size),
one as (select g, locus, arg_min(ho, md5('1:' || site_id)) as ho, arg_min(uhe, md5('1:' || site_id)) as uhe from f where p > 0 and p < 1 group by g, locus),
o as (select g, count(*) as k, avg(ho) as ho, sqrt(var_samp(ho) / count(*)) as hs, avg(uhe) as uhe, sqrt(var_samp(uhe) / count(*)) as us, avg(1 - ho / uhe) as fis, sqrt(var_samp(1 - ho / uhe) / count(*)) as fs from one group by g),
t as (select f.g, any_value(f.taxon) as taxon, count(distinct f.locus) as loci, count(*) as snps, sum(ho) as ho, sum(ho * ho) as ho2, sum(he) as he, sum(he * he) as he2 from f group by f.g),
m as (select t.*, snps + loci::double / l * inv as m from t join a using (taxon))
select 'grp' || z.g as pop, size::bigint as samples, coalesce(loci, 0)::bigint as loci_auto, coalesce(snps, 0)::bigint as snps, round(m.ho / m, 6) as ho_auto, round(sqrt((ho2 - m.ho * m.ho / m) / (m - 1) / m), 6) as ho_auto_se,
  round(m.he / m, 6) as he_auto, round(sqrt((he2 - m.he * m.he / m) / (m - 1) / m), 6) as he_auto_se, coalesce(k, 0)::bigint as unlinked_snps, round(o.ho, 6) as ho_snp, round(hs, 6) as ho_snp_se,
  round(uhe, 6) as uhe_snp, round(us, 6) as uhe_snp_se, round(fis, 6) as fis, round(fs, 6) as fis_se from z left join m on m.g = z.g left join o on o.g = z.g""")
def autosomal_table(spark, d):
    """Table of populations with standard errors; small groups in two taxa, so that sites without a missing call exist."""
    group = F.concat(F.lit("grp"), (F.col("sample_idx") % 15).cast("string"))
    people = FX.samples(spark, d).withColumn("pop", group)
    taxa = people.select("pop", F.when(F.col("sample_idx") % 15 < 8, "A").otherwise("B").alias("taxon")).distinct()
    invariant = spark.createDataFrame([("A", 300), ("B", 200)], "taxon string, invariant long")
    own = FX.calls(spark, d).drop("pop").join(people.select("sample", "pop"), "sample")
    return _rounded(DV.autosomal_table(own, people, invariant, taxa))


@query(""", z as (select pop, count(*) as size from samples group by pop), has as (select distinct c.pop, c.locus from calls c join sites using (site_id)),
k as (select c.locus, c.site_id, s.pop, s.sample, dosage from calls c join sites using (site_id) join samples s on s.sample = c.sample),
st as (select pop, locus, site_id, count(*) as m, avg((dosage = 1)::int) as ho, (1 - (sum(dosage) * (sum(dosage) - 1) + (2 * count(*) - sum(dosage)) * (2 * count(*) - sum(dosage) - 1))::double
    / (2 * count(*) * (2 * count(*) - 1))) * 2 * count(*) / (2 * count(*) - 1) as pi, count(distinct dosage) > 1 or max((dosage = 1)::int) = 1 as v from k group by all),
lo as (select pop, locus, count(distinct sample) as samples from k group by all),
l as (select st.pop, st.locus, any_value(samples) as samples, count(*) filter (v) as poly, 100 * (1 - sum(m)::double / (4 * any_value(size))) as miss, sum(ho * m) / sum(m) as ho, sum(pi * m) / sum(m) as pi,
  sum(case when pi > 0 then (pi - ho) / pi * m end) / sum(case when pi > 0 then m end) as fis from st join lo on lo.pop = st.pop and lo.locus = st.locus join z on z.pop = st.pop group by st.pop, st.locus),
p as (select pop, sample, locus, count(*) as n, count(*) filter (dosage = 1) as h from k group by all),
e as (select pop, sample, count(*) as loci, 4 * count(*) as sites, sum(h) as poly, sum(4 - n) as miss, sum(h::double / n) / count(*) as ho from p group by all),
x as (select pop, avg(loci) as sl, avg(sites) as ss, avg(poly) as sp, 100 * avg(miss::double / sites) as sm, avg(ho) as sh, sqrt(var_samp(ho) / count(*)) as se from e group by pop)
select l.pop, round(avg(samples), 6) as samples, count(*)::bigint as loci, (4 * count(*))::bigint as sites, sum(poly)::bigint as polymorphic, round(avg(miss), 6) as missing_percent, round(avg(ho), 6) as ho, round(sqrt(var_samp(ho) / count(ho)), 6) as ho_se,
  round(avg(pi), 6) as pi, round(sqrt(var_samp(pi) / count(pi)), 6) as pi_se, round(avg(fis), 6) as fis, round(sqrt(var_samp(fis) / count(fis)), 6) as fis_se, round(any_value(sl), 6) as samples_loci, round(any_value(ss), 6) as samples_sites,
  round(any_value(sp), 6) as samples_polymorphic, round(any_value(sm), 6) as samples_missing, round(any_value(sh), 6) as samples_ho, round(any_value(se), 6) as samples_ho_se from l join x on x.pop = l.pop group by l.pop""")
def alignment_table(spark, d):
    """Table of alignments by population."""
    return _rounded(DV.alignment_table(FX.sequences(spark, d), FX.samples(spark, d)))


@query(SP + PP + """, f as (select *, (a1 / (2 * n1) - a2 / (2 * n2)) ** 2 - h1 / (2 * n1) - h2 / (2 * n2) as num from
  (select *, a1 * (2 * n1 - a1) / (2 * n1 * (2 * n1 - 1)) as h1, a2 * (2 * n2 - a2) / (2 * n2 * (2 * n2 - 1)) as h2 from pp where n1 >= 2 and n2 >= 2))
select pop_a, pop_b, count(*)::bigint as sites, round(sum(num) / sum(num + h1 + h2), 4) as fst from f group by all""")
def reich_fst(spark, d):
    return PO.reich_fst(PO.site_pop(FX.calls(spark, d)))


@query(SP + PP + """, f as (select *, (4 * x0 * x2 + 2 * x1 * (x0 + x2) + x1 * (x1 - 1)) / (4 * n1 * (n1 - 1)) as h1, (4 * y0 * y2 + 2 * y1 * (y0 + y2) + y1 * (y1 - 1)) / (4 * n2 * (n2 - 1)) as h2,
  ((n2 * x1 + 2 * n2 * x2 - n1 * y1 - 2 * n1 * y2) ** 2 + x1 * n2 * n2 + y1 * n1 * n1) / (4 * n1 * n1 * n2 * n2) as x from pp where n1 >= 2 and n2 >= 2)
select pop_a, pop_b, count(*)::bigint as sites, round(sum(x - h1 / n1 - h2 / n2) / sum(x - h1 / n1 - h2 / n2 + h1 + h2), 4) as fst from f group by all""")
def reich_fst_inbred(spark, d):
    return PO.reich_fst_inbred(PO.site_pop(FX.calls(spark, d)))


@query(SP + PP + """, f as (select *, (n1 + n2) / 2 as nb, a1 / (2 * n1) as p1, a2 / (2 * n2) as p2, x1 / n1 as h1, y1 / n2 as h2 from pp where n1 + n2 > 2),
g as (select *, 2 * nb - (n1 * n1 + n2 * n2) / (2 * nb) as nc, (n1 * p1 + n2 * p2) / (2 * nb) as p, (n1 * h1 + n2 * h2) / (2 * nb) as h from f),
k as (select *, (n1 * (p1 - p) ** 2 + n2 * (p2 - p) ** 2) / nb as s2 from g),
w as (select pop_a, pop_b, nb / nc * (s2 - (p * (1 - p) - s2 / 2 - h / 4) / (nb - 1)) as a, nb / (nb - 1) * (p * (1 - p) - s2 / 2 - (2 * nb - 1) * h / (4 * nb)) as b, h / 2 as c from k)
select pop_a, pop_b, count(*)::bigint as sites, round(sum(a) / sum(a + b + c), 6) as fst from w group by all""")
def wc_fst(spark, d):
    return _rounded(PO.wc_fst(PO.site_pop(FX.calls(spark, d))))


# --- geography -----------------------------------------------------------------------------------

KM = PAIRS + """, geo as (select a, b, dist, 2 * 6378.137 * asin(least(1.0, sqrt(sin(radians(y.lat - x.lat) / 2) ** 2 + cos(radians(x.lat)) * cos(radians(y.lat)) * sin(radians(y.lon - x.lon) / 2) ** 2))) as km
  from pairs join samples x on x.sample = a join samples y on y.sample = b)"""


def _geo(spark, d, ellipsoid: bool = False) -> DataFrame:
    return I.with_km(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()), FX.samples(spark, d).select(F.col("sample").alias("id"), "lat", "lon"), ellipsoid)


@query(KM + " select a, b, round(km, 4) as km from geo")
def great_circle(spark, d):
    return _geo(spark, d).select("a", "b", F.round("km", 4).alias("km"))


def _vincenty(rounds: int = 12) -> str:
    """The steps of the iteration on the ellipsoid, written one after the other."""
    part = """sqrt((cos(p2) * sin(lam)) ** 2 + (cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(lam)) ** 2) as s, sin(p1) * sin(p2) + cos(p1) * cos(p2) * cos(lam) as c"""
    angle = "select *, case when s > 0 then cos(p1) * cos(p2) * sin(lam) / s else 0 end as al"
    more = "select *, 1 - al * al as c2, case when 1 - al * al > 1e-15 then c - 2 * sin(p1) * sin(p2) / (1 - al * al) else 0 end as mid"
    k = "(fl / 16 * c2 * (4 + fl * (4 - 3 * c2)))"
    at = "(select a, b, fl, p1, p2, diff, diff as lam from v)"
    for _ in range(rounds):
        inner = f"({more} from ({angle} from (select *, {part} from {at})))"
        at = f"(select a, b, fl, p1, p2, diff, diff + (1 - {k}) * fl * al * (atan2(s, c) + {k} * s * (mid + {k} * c * (2 * mid * mid - 1))) as lam from {inner})"
    last = f"({more} from ({angle} from (select *, {part} from {at})))"
    return f""", v as (select x.a, x.b, 1 / 298.257223563::double as fl, atan((1 - 1 / 298.257223563::double) * tan(radians(y.lat))) as p1, atan((1 - 1 / 298.257223563::double) * tan(radians(z.lat))) as p2, radians(z.lon - y.lon) as diff
  from pairs x join samples y on y.sample = x.a join samples z on z.sample = x.b),
e as (select *, 6378.137::double * (1 - fl) as minor, c2 * (1 / ((1 - fl) * (1 - fl)) - 1) as u2 from {last}),
f as (select *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) as big, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) as small from e)
select a, b, round(minor * big * (atan2(s, c) - small * s * (mid + small / 4 * (c * (2 * mid * mid - 1) - small / 6 * mid * (4 * s * s - 3) * (4 * mid * mid - 3)))), 4) as km from f"""


@query(PAIRS + _vincenty())
def geodesic(spark, d):
    return _geo(spark, d, True).select("a", "b", F.round("km", 4).alias("km"))


@query(KM + " select round(corr(dist, km), 6) as r, round(regr_slope(dist, km) * 10000, 6) as slope_per_100km from geo")
def distance_geo_corr(spark, d):
    return _rounded(I.distance_geo_corr(_geo(spark, d)))


IBD = """ select round(regr_slope(dist, km), 6) as slope, round(regr_intercept(dist, km), 6) as intercept, round(regr_r2(dist, km), 6) as r2, regr_count(dist, km)::bigint as n,
  round(1 - (1 - regr_r2(dist, km)) * (count(*) - 1) / (count(*) - 2), 6) as adj_r2 from {t}"""


@query(KM + IBD.format(t="geo"))
def ibd_regression(spark, d):
    return _rounded(I.ibd_regression(_geo(spark, d)))


@query(KM + """, r as (select regr_slope(dist, km) as slope, regr_r2(dist, km) as r2, regr_count(dist, km) as n from geo), t as (select *, sqrt(r2 * (n - 2) / (1 - r2)) as t, (n - 2)::double as f from r),
h as (select unnest(range(20001)) as i), dens as (select slope, n, t, f, sum((case when i in (0, 20000) then 1 when i % 2 = 1 then 4 else 2 end) * (1 + (t * i / 20000) ** 2 / f) ** (-(f + 1) / 2)) as s from t, h group by all),
area as (select slope, n, s * t / 60000 * exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(f * pi()) as half from dens)
select round(slope, 6) as slope, n::bigint as n, round(1 - 2 * half, 6) as p from area""")
def ibd_regression_p(spark, d):
    """The p of the slope; in SQL by Simpson's rule over the density of Student's t."""
    return _rounded(I.ibd_regression_p(_geo(spark, d)).select("slope", "n", "p"))


@query(KM + ", z as (select bool_or(km = 0) as z from geo), lin as (select dist / (1 - dist) as dist, case when z then ln(km + 1) else ln(km) end as km from geo, z)" + IBD.format(t="lin"))
def ibd_regression_linearised(spark, d):
    return _rounded(I.ibd_regression(I.linearised(_geo(spark, d))))


@query(KM + """, nm as (select name, row_number() over (order by name) - 1 as i from (select a as name from geo union select b from geo)),
g2 as materialized (select least(p.i, q.i) as p, greatest(p.i, q.i) as q, dist as x, km as y from geo join nm p on p.name = a join nm q on q.name = b),
put as materialized (select t, i, row_number() over (partition by t order by md5(concat_ws(':', '1', t::varchar, i::varchar))) - 1 as j from nm cross join (select unnest(range(199)) as t)),
perm as (select u.t, least(u.i, v.i) as p, greatest(u.i, v.i) as q, y from g2 join put u on u.j = g2.p join put v on v.t = u.t and v.j = g2.q),
r as (select t, corr(x, perm.y) as r from perm join g2 on g2.p = perm.p and g2.q = perm.q group by t), real as (select corr(x, y) as r from g2)
select round((select r from real), 6) as r, round((count(*) filter (r >= (select r from real) - 1e-12) + 1) / 200.0::double, 6) as p, (select count(*) from nm)::bigint as n from r""")
def mantel(spark, d):
    g = _geo(spark, d)
    return _rounded(I.mantel(g.select("a", "b", "dist"), g.select("a", "b", F.col("km").alias("dist")), 199))


@query()
def pca(spark, d):
    p = O.pca(FX.planes(spark, d), FX.names(), 3)
    return p.select("sample", "axis", F.round(F.abs("score"), 4).alias("abs_score"), "percent")


#: Power iteration in SQL: rows of the matrix of centred dosages times their turned ones, the greatest axes taken out one after the other.
POWER = """, m as (select site_id, avg(dosage) as mean from calls group by site_id),
x as materialized (select sample_idx as i, c.site_id, dosage - mean as v from calls c join m on m.site_id = c.site_id),
g0 as materialized (select a.i as i, b.i as j, sum(a.v * b.v) / 44 as v from x a join x b on a.site_id = b.site_id group by a.i, b.i),
full0 as materialized (select p.i, q.j, coalesce(v, 0) as v from (select unnest(range(44)) as i) p cross join (select unnest(range(44)) as j) q left join g0 on g0.i = p.i and g0.j = q.j),
total as (select sum(v) as t from full0 where i = j),
{steps}
select axis::bigint as axis, round(100 * l / t, 1) as percent from ({axes}), total"""


def _power(axes: int, rounds: int = 3000) -> str:
    steps, out = [], []
    for k in range(axes):
        steps.append(f"""r{k} as materialized (select i, list(v order by j) as r from full{k} group by i), rows{k} as materialized (select list(r order by i) as g from r{k}),
w{k} as materialized (with recursive p(n, v) as (select 0, list_transform(range(44), lambda i: 1.0::double + ((i * 7 + {k}) % 5) / 10.0::double)
    union all select n + 1, list_transform(u, lambda e: e / sqrt(list_dot_product(u, u))) from (select n, list_transform(g, lambda r: list_dot_product(r, v)) as u from p, rows{k} where n < {rounds}))
  select v, list_dot_product(v, list_transform(g, lambda r: list_dot_product(r, v))) as l from p, rows{k} where n = {rounds}),
full{k + 1} as materialized (select i, j, full{k}.v - l * w{k}.v[i + 1] * w{k}.v[j + 1] as v from full{k}, w{k})""")
        out.append(f"select {k + 1} as axis, l from w{k}")
    return POWER.format(steps=",\n".join(steps), axes=" union all ".join(out))


@query(_power(2))
def pca_variance(spark, d):
    """Shares of variance of the first two axes."""
    p = O.pca(FX.planes(spark, d), FX.names(), 2)
    return p.select(F.col("axis").cast("long").alias("axis"), "percent").distinct()


# --- sequences -----------------------------------------------------------------------------------


@query(""", g as (select c.locus, c.pos, case when a1 = 0 then ref else alt end as b1, case when a2 = 0 then ref else alt end as b2, sample from calls c join sites s on c.site_id = s.site_id),
u as (select locus, pos, sample, b1 as b from g union all select locus, pos, sample, b2 from g),
one as (select locus, pos, count(distinct case when b1 = b2 then b1 else least(b1, b2) || greatest(b1, b2) end) as k, bool_or(b1 = b2) as plain, min(least(b1, b2)) as m1, max(greatest(b1, b2)) as m2,
  count(distinct sample) as ns from g group by all)
select locus, pos::bigint as pos, ns::bigint as present, k::bigint as genotypes from one""")
def site_presence(spark, d):
    s = L.site_diversity(FX.sequences(spark, d), FX.N_SAMPLES)
    return s.select("locus", F.col("pos").cast("long").alias("pos"), F.col("present").cast("long").alias("present"), F.col("genotypes").cast("long").alias("genotypes"))


@query(""", st as (select locus, site_id, count(*) as m, avg((dosage = 1)::int) as ho, (1 - (sum(dosage) * (sum(dosage) - 1) + (2 * count(*) - sum(dosage)) * (2 * count(*) - sum(dosage) - 1))::double
    / (2 * count(*) * (2 * count(*) - 1))) * 2 * count(*) / (2 * count(*) - 1) as pi, count(distinct dosage) > 1 or max((dosage = 1)::int) = 1 as v from calls group by all),
lo as (select locus, count(distinct sample) as samples from calls group by locus)
select lo.locus, any_value(samples)::bigint as samples, 4::bigint as sites, count(*) filter (v)::bigint as polymorphic, round(100 * (1 - sum(m)::double / (4 * 44)), 6) as missing_percent,
  round(sum(ho * m) / sum(m), 6) as ho, round(sum(pi * m) / sum(m), 6) as pi, round(sum(case when pi > 0 then (pi - ho) / pi * m end) / sum(case when pi > 0 then m end), 6) as fis
from st join lo on st.locus = lo.locus group by lo.locus""")
def alignment_diversity(spark, d):
    return _rounded(L.alignment_diversity(FX.sequences(spark, d), FX.N_SAMPLES))


@query(""", p as (select sample, locus, count(*) as n, count(*) filter (dosage = 1) as h from calls group by all)
select sample, count(*)::bigint as loci, (4 * count(*))::bigint as sites, sum(h)::bigint as polymorphic, sum(4 - n)::bigint as missing, round(sum(h::double / n) / count(*), 6) as ho from p group by sample""")
def alignment_by_sample(spark, d):
    return _rounded(L.alignment_by_sample(FX.sequences(spark, d)))


@query(""", g as (select c.locus, c.pos, case when a1 = 0 then ref else alt end as b1, case when a2 = 0 then ref else alt end as b2 from calls c join sites s on c.site_id = s.site_id),
sq as (select distinct locus, pop, sample from calls),
hom as (select locus, pos, list_sort(list(distinct b1) filter (b1 = b2)) as bs, count(*) filter (b1 <> b2) as het, min(least(b1, b2)) as lo, max(greatest(b1, b2)) as hi from g group by all)
select locus, pos::bigint as pos, len(coalesce(bs, []))::bigint as plain, (het > 0) as any_het from hom""")
def site_bases(spark, d):
    at = L.positions(FX.sequences(spark, d), "locus").where("c != '?'")
    plain = F.col("c").isin("A", "C", "G", "T")
    return at.groupBy("locus", F.col("pos").cast("long").alias("pos")).agg(F.countDistinct(F.when(plain, F.col("c"))).alias("plain"), F.bool_or(~plain).alias("any_het"))


# --- runs, trees, sweeps -------------------------------------------------------------------------


@query(""", b as (select k, avg(likelihood) as m, stddev_samp(likelihood) as s from runs group by k), l as (select *, m - lag(m) over (order by k) as lp from b),
a as (select *, abs(lead(lp) over (order by k) - lp) as al from l)
select k::bigint as k, round(m, 4) as mean, round(s, 4) as std, round(lp, 4) as lprime, round(al, 4) as abs_ldprime, round(al / s, 6) as delta_k from a""")
def evanno(spark, d):
    e = RU.evanno(FX.runs(spark, d))
    return e.select(F.col("k").cast("long").alias("k"), *[F.round(c, 4).alias(c) for c in ("mean", "std", "lprime", "abs_ldprime")], F.round("delta_k", 6).alias("delta_k"))


@query(" select k::bigint as k, run, round(-likelihood, 2) as score, rank::bigint as rank from (select *, row_number() over (partition by k order by -likelihood, run) as rank from runs) where rank <= 10")
def best_runs(spark, d):
    r = FX.runs(spark, d).select("k", "run", (-F.col("likelihood")).alias("score"))
    return _rounded(RU.best_runs(r, 10), 2)


@query(" select k::bigint as k, arg_min(run, -likelihood) as run, round(min(-likelihood), 2) as score from runs group by k")
def best_per_k(spark, d):
    return _rounded(RU.best_per_k(FX.runs(spark, d).select("k", "run", (-F.col("likelihood")).alias("score"))), 2)


Q_SQL = ", q as (select sample_idx as row_idx, c as cluster, ((sample_idx * 7 + c * 3) % 10) / 10.0::double as prop from samples, range(3) t(c))"


def _q(spark, d) -> DataFrame:
    return FX.samples(spark, d).select(F.col("sample_idx").alias("row_idx"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cluster")).withColumn("prop", ((F.col("row_idx") * 7 + F.col("cluster") * 3) % 10) / 10)


@query(Q_SQL + " select dense_rank() over (order by pop, sample)::bigint as place, sample, pop, cluster::bigint as cluster, round(prop, 6) as prop from q join samples on row_idx = sample_idx")
def label_q(spark, d):
    return _rounded(RU.label_q(_q(spark, d), FX.samples(spark, d).select("sample_idx", "sample", "pop")))


@query(Q_SQL + """, l as (select dense_rank() over (order by pop, sample) as place, sample, pop, cluster, prop from q join samples on row_idx = sample_idx)
select 1::bigint as run, place::bigint as place, concat_ws(' ', place::varchar, sample, '(5)', pop, ':', string_agg(printf('%.4f', prop), ' ' order by cluster)) as line from l group by place, sample, pop""")
def clumpak_rows(spark, d):
    lab = RU.label_q(_q(spark, d), FX.samples(spark, d).select("sample_idx", "sample", "pop")).withColumn("run", F.lit(1))
    return _rounded(RU.clumpak_rows(lab))


@query(Q_SQL + """ select sample, case c when 0 then 'Pure0' when 1 then 'Pure1' when 2 then 'F1' when 3 then 'F2' when 4 then 'Bx0' else 'Bx1' end as class,
  round(((sample_idx * 5 + c) % 6) / 15.0::double, 6) as prob from samples, range(6) t(c)""")
def class_probabilities_long(spark, d):
    cols = [f"p{i}" for i in range(6)]
    wide = FX.samples(spark, d).select("sample", *[(((F.col("sample_idx") * 5 + i) % 6) / F.lit(15.0)).alias(c) for i, c in enumerate(cols)])
    return _rounded(RU.class_probabilities_long(wide, cols))


@query(""" select o_custkey % 5 as param, round(avg((o_orderkey % 100 + o_custkey % 100) / 2.0::double), 6) as mean_support from orders group by 1""")
def mean_bootstrap_by_param(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    tree = F.concat(F.lit("((a:1,b:2)"), (F.col("o_orderkey") % 100).cast("string"), F.lit(":0.1,(c:1,d:1)"), (F.col("o_custkey") % 100).cast("string"), F.lit(":0.2);"))
    return _rounded(o.select((F.col("o_custkey") % 5).alias("param"), M.mean_tree_support(tree).alias("s")).groupBy("param").agg(F.avg("s").alias("mean_support")))


@query(" select o_orderkey % 7 as g, round(avg((o_orderkey % 90) + 0.5::double), 6) as scf, count(*)::bigint as n from orders group by 1")
def concordance_factors(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = (F.col("o_orderkey") % 90).cast("string")
    text = F.concat(F.lit('[&label="100",sCF/sDF1/sDF2="'), k, F.lit('.5/20/10"]'))
    f = M.concordance_factors(text)
    return _rounded(o.select((F.col("o_orderkey") % 7).alias("g"), F.get(F.get(f, F.lit(0)), F.lit(0)).alias("s")).groupBy("g").agg(F.avg("s").alias("scf"), F.count(F.lit(1)).alias("n")))


@query(", h as (select k, stddev_samp(likelihood) / 1e5 as h from runs group by k), t as (select i, (select sum(j / (i * (i - j))::double) from range(1, 15) r(j) where j < i) as s from range(2, 16) t(i)) select k::bigint as k, i::bigint as n, round(s / h, 1) as lambda from h, t")
def yule_lambda(spark, d):
    h = FX.runs(spark, d).groupBy("k").agg((F.stddev_samp("likelihood") / 1e5).alias("h"))
    n = h.withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(15))))
    return n.select(F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), M.yule_lambda(F.col("h"), F.col("n").cast("double").cast("int")).alias("lambda"))


def _swept(spark, d) -> DataFrame:
    return FX.calls(spark, d).withColumn("param", F.concat(F.lit("P"), (F.col("site_id") % 3 + 1).cast("string")))


SWEPT = ", sw as (select *, concat('P', (site_id % 3 + 1)::varchar) as param from calls)"


@query(SWEPT + """, x as (select param, sample, avg((dosage = 1)::int) as het from sw group by all)
select param, round(min(het), 6) as min, round(quantile_cont(het, 0.25), 6) as q1, round(quantile_cont(het, 0.5), 6) as median, round(avg(het), 6) as mean, round(quantile_cont(het, 0.75), 6) as q3, round(max(het), 6) as max from x group by param""")
def sweep_box_summary(spark, d):
    return _rounded(SW.box_summary(S.snp_heterozygosity(_swept(spark, d), "param"), "het"))


@query(SWEPT + """, j as (select param, r.sample_a, r.sample_b, c.locus, c.site_id, max(case when c.sample = r.sample_a then dosage end) as da, max(case when c.sample = r.sample_b then dosage end) as db
  from sw c join reps r on c.sample = r.sample_a or c.sample = r.sample_b group by all),
l as (select param, sample_a, sample_b, locus, bool_or(da is not null) as ia, bool_or(db is not null) as ib, bool_or(da is distinct from db) as df,
  count(*) filter (da is not null and db is not null) as nb, count(*) filter (da <> db) as nd from j group by all)
select param, sample_a, sample_b, round(100.0::double * count(*) filter (not (ia and ib)) / count(*), 6) as locus_error,
  round(100.0::double * count(*) filter (ia and ib and df) / count(*) filter (ia and ib), 6) as allele_error, round(100.0::double * sum(nd) / sum(nb), 6) as snp_error from l group by all""")
def errors_by_param(spark, d):
    return _rounded(SW.errors_by_param(_swept(spark, d), FX.reps(spark)))


@query(f""", d as (select x.sample as a, y.sample as b, sqrt(sum((x.dosage - y.dosage) ** 2)::double * (select count(distinct site_id) from calls) / count(*)) as v
  from calls x join calls y on x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all)
select a, b, round(v / (select max(v) from d), 6) as dist from d""")
def euclidean_scaled(spark, d):
    """Euclidean distances divided by the greatest of them."""
    dist = PA.euclidean(FX.calls(spark, d), names=FX.names())
    top = dist.agg(F.max("dist").alias("top"))
    return _rounded(dist.crossJoin(F.broadcast(top)).select("a", "b", (F.col("dist") / F.col("top")).alias("dist")))


@query(SWEPT + f""", o as (select * from sw where sample not in (select sample_b from reps)), z as (select count(*) as size from samples where sample not in (select sample_b from reps)),
sz as (select param, count(distinct locus) as loci, count(distinct site_id) as snps from o group by param),
e as (select param, site_id, locus, count(*) as n, min(dosage) as lo, max(dosage) as hi from o group by all),
l8 as (select param, count(distinct locus) as k from e, z where lo <> hi and n >= 0.8 * size group by param),
ht as (select param, avg(h) as mh from (select param, sample, avg((dosage = 1)::int) as h from o group by all) group by param),
ds as (select x.param, x.sample as a, y.sample as b, {POFAD} as v from o x join o y on x.param = y.param and x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all),
w as (select param, avg(v) as mw from ds join samples p on p.sample = a join samples r on r.sample = b where p.pop = r.pop group by param)
select sz.param, sz.loci::bigint as loci, sz.snps::bigint as snps, coalesce(k, 0)::bigint as loci80, round(mh, 6) as mean_het, round(mw, 6) as mean_within
from sz left join l8 on sz.param = l8.param join ht on sz.param = ht.param left join w on sz.param = w.param""")
def optimise(spark, d):
    return _rounded(SW.optimise(_swept(spark, d), FX.samples(spark, d), FX.reps(spark)))


OPTIMISE = SWEPT + f""", o as (select * from sw where sample not in (select sample_b from reps)), left_ as (select * from samples where sample not in (select sample_b from reps)),
sz as (select param, count(distinct locus) as loci, count(distinct site_id) as snps from o group by param),
e as (select param, site_id, locus, count(*) as n, min(dosage) as lo, max(dosage) as hi from o group by all),
l8 as (select param, count(distinct locus) as k from e where lo <> hi and n >= 0.7 * (select count(*) from left_) group by param),
pz as (select pop, count(*) as size from left_ group by pop having count(*) >= 5),
ep as (select param, pop, site_id, locus, count(*) as n, min(dosage) as lo, max(dosage) as hi from o where sample in (select sample from left_) group by all),
lp as (select param, ep.pop, count(distinct locus) as k from ep join pz on pz.pop = ep.pop where lo <> hi and n >= 0.7 * size group by all),
la as (select p.param, avg(coalesce(k, 0)) as k from (select distinct param from o) p cross join pz left join lp on lp.param = p.param and lp.pop = pz.pop group by p.param),
ht as (select param, avg(h) as h from (select param, sample, avg((dosage = 1)::int) as h from o group by all) group by param),
j as (select param, r.sample_a, r.sample_b, c.locus, c.site_id, max(case when c.sample = r.sample_a then dosage end) as da, max(case when c.sample = r.sample_b then dosage end) as db
  from sw c join reps r on c.sample = r.sample_a or c.sample = r.sample_b group by all),
l as (select param, sample_a, sample_b, locus, bool_or(da is not null) as ia, bool_or(db is not null) as ib, bool_or(da is distinct from db) as df,
  count(*) filter (da is not null and db is not null) as nb, count(*) filter (da <> db) as nd from j group by all),
er as (select param, avg(x) as locus_error, avg(y) as allele_error, avg(z) as snp_error from (select param, 100.0::double * count(*) filter (not (ia and ib)) / count(*) as x,
  100.0::double * count(*) filter (ia and ib and df) / count(*) filter (ia and ib) as y, 100.0::double * sum(nd) / sum(nb) as z from l group by param, sample_a, sample_b) group by param),
ds as (select x.param, x.sample as a, y.sample as b, {POFAD} as v from o x join o y on x.param = y.param and x.site_id = y.site_id and x.sample_idx < y.sample_idx group by all),
w as (select param, avg(v) filter (p.pop = r.pop) as mw, avg(v) filter (p.pop <> r.pop) as mb from ds join left_ p on p.sample = a join left_ r on r.sample = b group by param)
select sz.param, sz.loci::bigint as loci, sz.snps::bigint as snps, coalesce(l8.k, 0)::bigint as loci80, round(la.k, 6) as loci80_pop, round(locus_error, 6) as locus_error, round(allele_error, 6) as allele_error, round(snp_error, 6) as snp_error,
  round(ht.h, 6) as snp_het, round(ht.h, 6) as seq_het, round(mw, 6) as mean_within, round(mb, 6) as mean_between
from sz left join l8 on l8.param = sz.param left join la on la.param = sz.param left join ht on ht.param = sz.param left join er on er.param = sz.param left join w on w.param = sz.param"""


@query(OPTIMISE)
def optimise_table(spark, d):
    """All figures of a sweep, one row for each parameter value."""
    seqs = FX.sequences(spark, d, "param", _swept(spark, d))
    return _rounded(SW.optimise_table(_swept(spark, d), seqs, FX.samples(spark, d), FX.reps(spark), 0.7))


# --- text in and out -----------------------------------------------------------------------------


@query(" select site_id, sample_idx::bigint as sample_idx, dosage::bigint as dosage, dp::bigint as dp from calls where site_id in (select site_id from sites)")
def vcf_round_trip(spark, d):
    """Calls as VCF text and back."""
    sites = V.parse_lines(FX.vcf_lines(spark, d).withColumnRenamed("site_id", "n"))
    cells = F.transform("calls", lambda c, i: F.struct(i.cast("long").alias("sample_idx"), G.dosage(c["gt"]).cast("long").alias("dosage"), c["dp"].cast("long").alias("dp")))
    # Parsed rows are cached, so that exploding does not repeat the parsing in its filters.
    return sites.select(F.col("n").alias("site_id"), cells.alias("cells")).cache().select("site_id", F.inline("cells")).where("dosage is not null")


@query(" select site_id, 44::bigint as n_pl, count(*)::bigint as n_called from calls where site_id in (select site_id from sites) group by site_id")
def add_pl(spark, d):
    sites = V.add_pl(V.parse_lines(FX.vcf_lines(spark, d).withColumnRenamed("site_id", "n")))
    return sites.select(F.col("n").alias("site_id"), F.size(F.filter("calls", lambda c: F.size(c["pl"]) == 3)).cast("long").alias("n_pl"), P.n_called().cast("long").alias("n_called"))


def _few(spark, d):
    """Calls, samples and numbered sites, for the export formats."""
    calls = FX.coded(spark, d)
    sites = S.with_site_index(FX.sites(spark, d).select("site_id"), "site_id")
    return calls, FX.samples(spark, d), sites


GRID = """, grid as (select sample_idx, sample, pop, site_id, ref, alt from samples, sites),
cell as (select g.*, c.a1, c.a2, c.dosage, case when c.a1 = 0 then ref when c.a1 = 1 then alt end as b1, case when c.a2 = 0 then ref when c.a2 = 1 then alt end as b2
  from grid g left join calls c on c.sample_idx = g.sample_idx and c.site_id = g.site_id)"""
CODE = "case when dosage is null then '?' when b1 = b2 then b1 when least(b1, b2) || greatest(b1, b2) = 'AC' then 'M' when least(b1, b2) || greatest(b1, b2) = 'AG' then 'R' when least(b1, b2) || greatest(b1, b2) = 'AT' then 'W' when least(b1, b2) || greatest(b1, b2) = 'CG' then 'S' when least(b1, b2) || greatest(b1, b2) = 'CT' then 'Y' else 'K' end"


@query(GRID + """ select sample_idx::bigint as sample_idx, 0::bigint as hap, concat(sample, chr(9), pop, chr(9), string_agg(coalesce(a1 + 1, -9)::varchar, chr(9) order by site_id)) as line from cell group by sample_idx, sample, pop
union all select sample_idx::bigint, 1::bigint, concat(sample, chr(9), pop, chr(9), string_agg(coalesce(a2 + 1, -9)::varchar, chr(9) order by site_id)) from cell group by sample_idx, sample, pop""")
def to_structure(spark, d):
    return _rounded(X.to_structure(*_few(spark, d)))


@query(GRID + """ select sample_idx::bigint as sample_idx, concat((sample_idx + 1)::varchar, ' n  ', sample, chr(9), string_agg(case when dosage is null then '0' else concat((a1 + 1)::varchar, (a2 + 1)::varchar) end, ' ' order by site_id)) as line from cell group by sample_idx, sample""")
def to_newhybrids(spark, d):
    return _rounded(X.to_newhybrids(*_few(spark, d)))


@query(GRID + " select sample_idx::bigint as sample_idx, concat(sample, chr(9), string_agg(coalesce(dosage::varchar, '?'), '' order by site_id)) as line from cell group by sample_idx, sample")
def to_nexus_snapp(spark, d):
    return _rounded(X.to_nexus(*_few(spark, d)))


@query(GRID + " select sample_idx::bigint as sample_idx, concat(sample, chr(9), string_agg(case when dosage is null then '??' else least(b1, b2) || greatest(b1, b2) end, '' order by site_id)) as line from cell group by sample_idx, sample")
def to_nexus_splits(spark, d):
    return _rounded(X.to_nexus(*_few(spark, d), "splits"))


@query(GRID + """, v as (select site_id from calls where site_id in (select site_id from sites) group by site_id having min(least(a1, a2)) <> max(greatest(a1, a2))),
w as (select site_id, least(a1, a2) as lo, greatest(a1, a2) as hi, count(distinct pop) as p from calls group by all), shared as (select site_id from w group by site_id having count(*) > 2 or (count(*) = 2 and min(p) >= 2)),
pick as (select site_id from v semi join shared using (site_id) order by ('0x' || substr(md5('1:' || site_id), 1, 8))::bigint, site_id limit 500)
select sample_idx::bigint as sample_idx, concat(sample, chr(9), string_agg(coalesce(dosage::varchar, '?'), '' order by site_id)) as line from cell semi join pick using (site_id) group by sample_idx, sample""")
def nexus_downsampled(spark, d):
    """NEXUS rows of 500 sites that vary and are not autapomorphic."""
    calls = FX.coded(spark, d)
    order = F.conv(F.substring(F.md5(F.concat(F.lit("1:"), F.col("site_id").cast("string"))), 1, 8), 16, 10).cast("long")
    return _rounded(X.to_nexus(calls, FX.samples(spark, d), X.nexus_sites(calls, shared=True, n=500, order=order)))


@query(GRID + f" select sample_idx::bigint as sample_idx, 0::bigint as hap, concat(sample, chr(9), string_agg({CODE}, '' order by site_id)) as line from cell group by sample_idx, sample")
def to_svdquartets(spark, d):
    return _rounded(X.to_svdquartets(*_few(spark, d)))


@query(GRID + """ select sample_idx::bigint as sample_idx, 0::bigint as hap, concat(sample, '_A', chr(9), string_agg(coalesce(b1, '?'), '' order by site_id)) as line from cell group by sample_idx, sample
union all select sample_idx::bigint, 1::bigint, concat(sample, '_B', chr(9), string_agg(coalesce(b2, '?'), '' order by site_id)) from cell group by sample_idx, sample""")
def to_svdquartets_hap(spark, d):
    return _rounded(X.to_svdquartets(*_few(spark, d), "hap"))


@query(" select concat(pop, ' : ', string_agg((sample_idx + 1)::varchar, ' ' order by sample_idx)) as line from samples group by pop")
def taxon_sets(spark, d):
    return X.taxon_sets(FX.samples(spark, d))


@query(GRID + f" select pop, sample, concat(sample, chr(9), string_agg({CODE}, '' order by site_id)) as line from cell group by pop, sample")
def to_hyde(spark, d):
    return X.to_hyde(*_few(spark, d))


@query(GRID + f" select sample_idx::bigint as sample_idx, concat('>', sample, chr(10), string_agg({CODE}, '' order by site_id)) as record from cell group by sample_idx, sample")
def to_fasta(spark, d):
    return _rounded(X.to_fasta(*_few(spark, d)))


@query(GRID + " select sample_idx::bigint as sample_idx, string_agg(coalesce(dosage, 9)::varchar, '' order by site_id) as line from cell group by sample_idx")
def to_geno(spark, d):
    return _rounded(X.to_geno(*_few(spark, d)))


@query(SP + ", g as (select distinct site_id, p.pop from sp, (select distinct pop from calls) p) select g.site_id, string_agg(concat(coalesce(2 * n - alt, 0)::varchar, ',', coalesce(alt, 0)::varchar), ' ' order by g.pop) as line from g left join sp on sp.site_id = g.site_id and sp.pop = g.pop group by g.site_id")
def to_treemix(spark, d):
    pops = [f"pop{i}" for i in range(5)]
    return X.to_treemix(PO.allele_counts(PO.site_pop(FX.calls(spark, d)), pops), pops)


BEAGLE = """, sm as (select range as i from range(44)),
lik as (select s.site_id, i, c.dosage, list_transform([0, 1, 2], lambda g: case when c.dosage is null then 1.0::double else 10.0::double ** -abs(g - c.dosage) end) as raw
  from sites s cross join sm left join calls c on c.site_id = s.site_id and c.sample_idx = i where s.site_id in (select site_id from calls))
select site_id as site_idx, concat_ws(chr(9), any_value(snp_id), any_value(ref), any_value(alt), string_agg(concat_ws(chr(9), printf('%.4f', raw[1] / t), printf('%.4f', raw[2] / t), printf('%.4f', raw[3] / t)), chr(9) order by i)) as line
from (select *, list_sum(raw) as t from lik) join sites using (site_id) group by site_id"""


@query(BEAGLE)
def to_beagle(spark, d):
    """Likelihoods from PL of ten for each step between genotypes; a third each for a missing call."""
    sites = V.parse_lines(FX.vcf_lines(spark, d).withColumnRenamed("site_id", "site_idx"))
    pl = lambda c: F.when(G.is_called(c["gt"]), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda g: F.abs(g - G.dosage(c["gt"])).cast("double") * 10))
    return X.to_beagle(sites.withColumn("calls", F.transform("calls", lambda c: c.withField("pl", pl(c)))))


@query(PAIRS + """, s as (select a, b, dist from pairs union all select b, a, dist from pairs), f as (select * from s union all select distinct a, a, 0.0::double from s)
select a, concat(a, ' ', string_agg(printf('%.6f', round(dist, 6)), ' ' order by b)) as line from f group by a""")
def to_nexus_distances(spark, d):
    return X.to_nexus_distances(PA.genotype_mismatch(FX.calls(spark, d), names=FX.names()))


@query(""", h as (select distinct sample from calls where sample_idx < 42), t as (select sample from samples where sample_idx > 2)
select sample, 'table' as missing_from from h where sample not in (select sample from t) union all select sample, 'data' from t where sample not in (select sample from h)""")
def unmatched_samples(spark, d):
    have = FX.calls(spark, d).where("sample_idx < 42").select("sample").distinct()
    return V.unmatched(have, FX.samples(spark, d).where("sample_idx > 2").select("sample"))


from . import file_queries  # noqa: E402, F401  (registers its queries)
