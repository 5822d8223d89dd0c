"""Freely typed values mapped to a reference list, in SQL alone.

Distinct values are cleaned and compared four ways, the cheapest first; the first way that matches decides:

1. the letters and digits are those of a reference string or alias ("focal_adhesion;", "adhesion, Focal", "FA");
2. words cut short with a full stop begin the words of a reference string ("Nucl. pore complex");
3. edit distance at most k. By the pigeonhole principle a reference string cut into k + 1 segments then has one segment
   that stands unchanged in the value, moved by no more than the edits around it: segments and the value's substrings at
   those places are joined by equality, and ``levenshtein`` verifies what the join brings;
4. what no way matches is found by an anti-join and reported with id 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from profilespark.session import Scratch, broadcast_if_small

# Letters that look like a Latin one, and accented ones, by place (fixed values).
LOOKALIKE = ("аеорсухіјѕкмтАВЕКМНОРСТУХІЈЅοανικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijskmtABEKMHOPCTYXIJSoavikABEZHIKMNOPTYX")
ACCENT = ("àáâãäåāçćčèéêëēìíîïīñńòóôõöøōšùúûüūýÿž", "aaaaaaaccceeeeeiiiiinnooooooosuuuuuyyz")

#: Words and marks set before or after a name (fixed values).
HEDGE = r"(?:\d+[).]|[?*#~]+|[a-z0-9]{2,6}:|prob(?:\.|ably)?|likely|mostly|mainly|maybe|possibly|partly|putative|presumably|in|the|at|near|approx\.?|ca\.?)"


def clean(e: str) -> str:
    """SQL for a value in lower case, without accents, brackets, hedges before it and remarks after it."""
    e = f"lower(translate({e}, '{LOOKALIKE[0]}', '{LOOKALIKE[1]}'))"
    e = f"translate({e}, '{ACCENT[0]}', '{ACCENT[1]}')"
    e = f"regexp_replace({e}, r'[(\\[][^)\\]]*[)\\]]', ' ')"
    e = f"regexp_replace({e}, r'\\s+[-/|]\\s+.*$', '')"
    e = f"regexp_replace(trim({e}), r'^(?:{HEDGE}\\s+)+', '')"
    e = f"regexp_replace({e}, r'^[^a-z0-9]+|[^a-z0-9]+$', '')"
    return e.replace("{", "{{").replace("}", "}}")  # braces name tables in the statements below


#: Edits allowed for a reference string of n letters and digits: about one in four. Strings under five allow none, as one edit
#: makes another word of them; a value further off means no entry and is reported.
EDITS = "CASE WHEN n >= 12 THEN 4 WHEN n >= 8 THEN 3 WHEN n >= 6 THEN 2 WHEN n = 5 THEN 1 ELSE 0 END"
MOST_EDITS = 4


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """value, ref_id, how, distance for each distinct value of ``values(value)``; ref_id 0 where none is meant.

    reference(ref_id, name, aliases): names and aliases are compared, aliases may be null. A value that fits several
    entries gets the one at the smallest distance, of equal ones the smallest id. Null values are left out. The
    reference list is broadcast if it is small, which is counted; else all joins are by hash, as all are on equality.
    """
    sql = values.sparkSession.sql
    scratch = Scratch(values.sparkSession, "mapping")
    strings = sql(
        """SELECT DISTINCT ref_id, s, primary, regexp_replace(s, r'[^a-z0-9]', '') AS key FROM (
          SELECT ref_id, lower(translate(name, '{a}', '{b}')) AS s, TRUE AS primary FROM {{reference}} WHERE ref_id IS NOT NULL AND name IS NOT NULL
          UNION ALL SELECT ref_id, lower(translate(t.alias, '{a}', '{b}')), FALSE FROM {{reference}} LATERAL VIEW explode(aliases) t AS alias WHERE ref_id IS NOT NULL AND t.alias IS NOT NULL)""".format(a=ACCENT[0], b=ACCENT[1]),
        reference=reference,
    ).where("key <> ''")
    strings = broadcast_if_small(strings)
    forms = sql(
        f"""SELECT DISTINCT value, c, explode(array_distinct(array(
              regexp_replace(c, r'[^a-z0-9]', ''),
              regexp_replace(CASE WHEN c LIKE '%,%' THEN regexp_replace(c, r'^([^,]*),(.*)$', '$2 $1') ELSE c END, r'[^a-z0-9]', '')))) AS key
            FROM (SELECT value, {clean("value")} AS c FROM (SELECT DISTINCT value FROM {{values}} WHERE value IS NOT NULL))""",
        values=values,
    )
    forms = scratch.write(forms)
    exact = sql("SELECT value, min(ref_id) AS ref_id, 'exact' AS how, 0 AS distance FROM {forms} f JOIN {strings} s USING (key) GROUP BY value", forms=forms, strings=strings)
    exact = scratch.write(exact)
    left = sql("SELECT f.* FROM {forms} f LEFT ANTI JOIN {exact} e ON f.value = e.value WHERE f.key <> ''", forms=forms, exact=exact)
    cut = sql(
        r"""SELECT value, min(ref_id) AS ref_id, 'abbreviated' AS how, 0 AS distance FROM
          (SELECT DISTINCT value, t, transform(t, x -> substr(x, 1, 1)) AS heads FROM (SELECT value, split(regexp_replace(c, '-', ''), r'\s+') AS t FROM {left} WHERE c RLIKE r'[a-z]\.\s')) v
          JOIN (SELECT ref_id, t, transform(t, x -> substr(x, 1, 1)) AS heads FROM (SELECT ref_id, split(regexp_replace(s, '-', ''), r'\s+') AS t FROM {strings} WHERE primary)) r
          ON v.heads = r.heads
          WHERE forall(zip_with(v.t, r.t, (a, b) -> CASE WHEN a LIKE '%.' THEN startswith(b, rtrim('.', a)) ELSE levenshtein(a, b) <= 1 END), x -> x)
          GROUP BY value""",
        left=left,
        strings=strings,
    )
    cut = scratch.write(cut)
    left = sql("SELECT f.* FROM {left} f LEFT ANTI JOIN {cut} e ON f.value = e.value", left=left, cut=cut)
    segments = sql(
        f"""SELECT ref_id, key, n, k, i, substr(key, CAST(floor(i * n / (k + 1)) AS INT) + 1, CAST(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) AS INT)) AS part
            FROM (SELECT ref_id, key, n, k, explode(sequence(0, k)) AS i FROM (SELECT *, {EDITS} AS k FROM (SELECT DISTINCT ref_id, key, length(key) AS n FROM {{strings}})) WHERE k > 0)""",
        strings=strings,
    )
    segments = broadcast_if_small(segments)
    lengths = broadcast_if_small(sql("SELECT DISTINCT n, k FROM {segments}", segments=segments))
    pieces = sql(
        f"""SELECT value, vkey, n, k, i, substr(vkey, p + 1, CAST(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) AS INT)) AS part
            FROM (SELECT value, vkey, n, k, i, explode(CASE WHEN lo <= hi THEN sequence(lo, hi) END) AS p
              FROM (SELECT value, vkey, n, k, i, greatest(0, at - i, at + m - n - (k - i)) AS lo, least(m, at + i, at + m - n + (k - i)) AS hi
                FROM (SELECT *, CAST(floor(i * n / (k + 1)) AS INT) AS at
                  FROM (SELECT value, vkey, m, l.n, l.k, explode(sequence(0, l.k)) AS i
                    FROM (SELECT value, key AS vkey, length(key) AS m, explode(sequence(length(key) - {MOST_EDITS}, length(key) + {MOST_EDITS})) AS n FROM {{left}}) v
                    JOIN {{lengths}} l ON v.n = l.n AND abs(v.m - l.n) <= l.k))))""",
        left=left,
        lengths=lengths,
    )
    near = sql(
        """SELECT value, min_by(ref_id, struct(d, ref_id)) AS ref_id, 'edited' AS how, min(d) AS distance
           FROM (SELECT value, ref_id, levenshtein(vkey, key, k) AS d
             FROM (SELECT DISTINCT p.value, p.vkey, s.ref_id, s.key, s.k FROM {pieces} p JOIN {segments} s ON p.n = s.n AND p.i = s.i AND p.part = s.part))
           WHERE d >= 0 GROUP BY value""",
        pieces=pieces,
        segments=segments,
    )
    found = exact.unionByName(cut).unionByName(scratch.write(near))
    none = sql("SELECT v.value, 0 AS ref_id, 'unmatched' AS how, CAST(NULL AS INT) AS distance FROM (SELECT DISTINCT value FROM {forms}) v LEFT ANTI JOIN {found} f ON v.value = f.value", forms=forms, found=found)
    return found.unionByName(none)


def map_labels(proteins: DataFrame, compartments: DataFrame) -> DataFrame:
    """field_name, obs_id, value, compartment_id, how of each value typed into markers or cell_compartment.

    Left out: null and blank values, the word unknown, and values that are a compartment to the letter.
    """
    sql = proteins.sparkSession.sql
    typed = sql(
        """SELECT DISTINCT t.field_name, obs_id, t.value FROM {proteins} LATERAL VIEW stack(2, 'markers', markers, 'cell_compartment', cell_compartment) t AS field_name, value
           WHERE obs_id IS NOT NULL AND t.value IS NOT NULL AND regexp_replace(t.value, r'\\s', '') <> '' AND lower(trim(t.value)) <> 'unknown'""",
        proteins=proteins.select("obs_id", "markers", "cell_compartment"),
    )
    names = broadcast_if_small(sql("SELECT DISTINCT compartment AS value FROM {c} WHERE compartment IS NOT NULL", c=compartments))
    typed = sql("SELECT t.* FROM {typed} t LEFT ANTI JOIN {names} n ON t.value = n.value", typed=typed, names=names)
    reference = compartments.selectExpr("compartment_id AS ref_id", "compartment AS name", "aliases")
    mapped = map_values(typed.select("value").distinct(), reference)
    return sql("SELECT t.field_name, t.obs_id, t.value, CAST(m.ref_id AS INT) AS compartment_id, m.how FROM {typed} t JOIN {mapped} m ON t.value = m.value", typed=typed, mapped=mapped)


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """field_name, value, n: the values that mean no entry, with how often each was typed."""
    return mapped.sparkSession.sql("SELECT field_name, value, count(*) AS n FROM {m} WHERE compartment_id = 0 GROUP BY field_name, value", m=mapped)
