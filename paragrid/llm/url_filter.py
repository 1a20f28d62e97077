"""URL filter: fixed rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes are counted per host and shrunk through beta-binomial priors: the global rate, itself shrunk by a
Beta(1/2, 1/2) prior over as many outcomes as suffixes have labels, so that few labels can't make it 0 or 1, is the prior mean
of each suffix, a suffix's posterior mean that of its registered domains, a domain's that of its hosts. Each level's prior strength is fitted by moments over that level's groups, and is at most what the level above is worth in labels. A host is blocked when the
lower bound of its posterior rate of bad pages passes a threshold. The bound is the posterior mean less z posterior standard
deviations, a normal approximation: SQL has no quantile of the beta distribution. URLs are tallied by host once; that table is
written, and domains and suffixes are summed from it.

A registered domain is one label below a public suffix: the last label, or the last two where ``suffixes`` lists them or where a
two-letter country's second label is one of ``SECOND_LEVEL``. A port and what stands before an @ are no part of the domain; an IP
address is a domain and a suffix of its own.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule; all such pages
share the empty host's reputation. An unlabelled host takes its domain's rate, an unlabelled domain its
suffix's. Without any labels nothing is blocked except by rule. Repeated rows are judged each; a null page
id stays null. Columns of the input other than the id and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrid.llm.common import LOWER, UPPER, materialize

#: Fixed values: (verdict, host, path) of the rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Second-level labels under which domains are registered in two-letter suffixes.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Further suffixes of two labels under which anyone registers names.
SUFFIXES = [
    "asso.fr", "gouv.fr", "ltd.uk", "me.uk", "nhs.uk", "plc.uk", "police.uk", "sch.uk", "asn.au", "id.au", "ad.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp", "go.kr", "ne.kr", "or.kr", "re.kr",
    "gen.in", "firm.in", "ind.in", "nic.in", "res.in", "art.br", "blog.br", "eco.br", "gob.mx", "gob.ar", "gob.es", "nom.es", "gv.at", "or.at", "gen.nz", "geek.nz", "govt.nz", "iwi.nz", "kiwi.nz", "maori.nz", "school.nz",
    "go.id", "or.id", "sch.id", "web.id", "gen.tr", "web.tr", "gov.pl", "info.pl", "waw.pl", "law.za", "nom.za", "school.za", "web.za", "idv.tw", "idv.hk", "in.th", "go.th", "or.th", "msk.ru", "spb.ru", "pp.ru",
    "blogspot.com", "github.io", "gitlab.io", "netlify.app", "vercel.app", "web.app", "firebaseapp.com", "herokuapp.com", "pages.dev", "workers.dev", "wordpress.com", "tumblr.com", "weebly.com", "wixsite.com", "livejournal.com", "narod.ru",
]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _name_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^[\s\S]*@", ""), ":[0-9]*$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The public suffix: the registered domain without its first label (of a domain of one label, that label; of an address, itself)."""
    name = _name_of(host)
    return F.when(_is_address(name), name).otherwise(F.regexp_replace(domain_of(host, suffixes), r"^[^.]*\.", ""))


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    name = _name_of(host)
    parts = F.split(name, r"\.")
    three = (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(SECOND_LEVEL) | F.substring_index(name, ".", -2).isin(list(suffixes))
    return F.when(_is_address(name), name).when(three & (F.size(parts) > 2), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def _with_rate(groups: DataFrame, prior: DataFrame | None, on: str | None, z: float = 0.0) -> DataFrame:
    """Adds ``rate`` (posterior mean), ``low`` (its lower bound) and ``total`` (labels that it is worth) to groups of (n, bad), given the level above.

    A prior is worth no more labels than the level above has: at the top, one for each labelled group and one more."""
    if prior is None:
        pooled, labelled = F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)), F.count(F.when(F.col("n") > 0, 1))
        top = groups.agg(((labelled * pooled + 0.5) / (labelled + 1)).alias("mean"), (labelled + 1).cast("double").alias("most"))
        groups = groups.crossJoin(F.broadcast(top))  # one row
    else:
        groups = groups.join(prior.select(on, F.col("rate").alias("mean"), F.col("total").alias("most")), on)
    groups = materialize(groups, "groups")
    total, spread = F.sum("n"), F.sum(F.when(F.col("n") > 0, F.try_divide(F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2), F.col("n"))).otherwise(0.0))
    inside, at = F.sum(F.when(F.col("n") > 0, F.col("mean") * (1 - F.col("mean"))).otherwise(0.0)), F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean")))
    strength = groups.agg(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.try_divide(at, F.greatest(spread - inside, 1e-6 * total)) - 1)), F.lit(1.0)).alias("k"))
    own = groups.crossJoin(F.broadcast(strength)).withColumn("k", F.least("k", "most"))
    rated = own.withColumn("total", F.col("n") + F.col("k")).withColumn("rate", (F.col("bad") + F.col("k") * F.col("mean")) / F.col("total"))
    return rated.withColumn("low", F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("total") + 1))).drop("mean", "k", "most")


def host_reputation(labelled: DataFrame, z: float = 1.645, suffixes=SUFFIXES) -> DataFrame:
    """host, n, bad, rate, low from (host, bad); bad is 0, 1 or null (not labelled)."""
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = _with_rate(tops, None, None)
    domains = _with_rate(domains, tops, "suffix")
    return _with_rate(hosts, domains, "domain", z).select("host", "n", "bad", "rate", "low")


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", key: Column | None = None, most_bad: float = 0.5, z: float = 1.645, rules=RULES, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, low of every page.

    labels: (key, bad); ``key`` says what of a page is looked up there (its id by default)."""
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), (F.col(id_col) if key is None else key).alias("key"))
    bad = labels.groupBy("key").agg(F.max("bad").cast("long").alias("bad"))
    reputation = host_reputation(judged.join(bad, "key", "left").select("host", "bad"), z, suffixes)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return judged.join(reputation.select("host", "rate", "low"), "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("low") > most_bad, "block").otherwise("allow")).alias("verdict"), "rate", "low"
    )
