"""Inputs of the registered queries, shaped from the given tables.

The SQL texts run in Spark and in DuckDB. They add spellings, gaps and odd values to the tables by
``CASE``; every row of a table stays in, but for system turns and for user turns that are the question of a
reply.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscale.session import configure, deal, scratch_path

# Judged answers: ids, models, verdicts and scores in all the spellings the report must read.
EVAL_ROWS = """
select d.doc_id,
       concat(case lang when 'en' then ' EN' when 'de' then 'cn' else upper(lang) end, '_',
              case when d.doc_id % 19 = 0 then 'x' else lpad(cast(d.doc_id % 5 as string), 3, '0') end) as id,
       nullif(source, 'src0') as model,
       case when d.doc_id % 11 = 0 then '[Correct].'
            when quality = 1 and toxic = 0 then 'why [x] [Correct] '
            when quality = 1 then '[ CORRECT ]'
            when quality = 0 then '[Incorrect]' end as judge,
       case when d.doc_id % 13 = 0 then 'abc' when d.doc_id % 17 = 0 then null when d.doc_id % 23 = 0 then 'nan'
            else cast(cast(n_chars as double) / 1000e0 as string) end as sim
from documents d left join labels l on d.doc_id = l.doc_id
"""

# The largest table as judged answers: 40 models, one item per order line.
LINE_ROWS = """
select concat(case l_returnflag when 'A' then 'EN' when 'N' then ' cn' else 'fr' end, '_',
              lpad(cast(l_linenumber as string), 2, '0')) as id,
       concat('m', cast(l_suppkey % 40 as string)) as model,
       case when l_discount < 0.02e0 then null when l_discount < 0.07e0 then '[Correct]' else '[Incorrect]' end as judge,
       l_extendedprice / 100000e0 as sim
from lineitem
"""

# One row per assistant turn, with the question before it and a reference text; one without an answer per
# user turn that has no reply.
QA_ROWS = """
select a.conv_id, a.turn, case when a.role = 'user' then a.text else q.text end as question,
       case when a.role = 'assistant' then a.text end as answer, b.text as reference
from conversations a
left join conversations q on q.conv_id = a.conv_id and q.turn = a.turn - 1 and q.role = 'user'
left join conversations r on r.conv_id = a.conv_id and r.turn = a.turn + 1 and r.role = 'assistant'
join benchmark b on b.item_id = a.conv_id % (select count(*) from benchmark)
where a.role = 'assistant' or (a.role = 'user' and r.role is null)
"""

# The same rows with the text of their conversation's system turn, if it has one.
SYSTEM_ROWS = f"""
select a.*, s.instruction
from ({QA_ROWS}) a
left join (select conv_id, max(text) as instruction from conversations where role = 'system' group by conv_id) s
  on s.conv_id = a.conv_id
"""

# Source texts with a question each; some questions are missing.
PROMPT_ROWS = """
select doc_id, text, case when lang <> 'fr' then concat('What does {problem} mean in ', source, '?') end as question
from documents
"""

# Typed rows with regional tags under the present or the legacy key, and padded ids.
TAGGED_ROWS = """
select doc_id, concat(' d', cast(doc_id as string), ' ') as id, text,
       case lang when 'en' then ' EN-US' when 'es' then 'es' end as language,
       case lang when 'de' then 'ZH-CN ' when 'es' then 'zh' end as ",language"
from documents
"""

# Parts of the JSON rows below, as JSON text: the id, the language tags, the generation fields.
RAW_PARTS = """
select doc_id, text, lang,
       case doc_id % 9 when 0 then '"id":null,' when 1 then '"id":true,' when 2 then '"id":" EN_0012 ",'
                       when 3 then '"id":12,' when 4 then '"id":[1, 2],' when 5 then '' when 6 then '"id":1.50,'
                       when 7 then '"id":false,' else concat('"id":"d', cast(doc_id as string), '",') end as id_part,
       case when lang = 'en' and doc_id % 2 = 0 then '"language":" EN-US ",'
            when lang = 'en' then '"language":"en",",language":"zh",'
            when lang = 'de' then '",language":"ZH-CN",'
            when lang = 'es' then '"language":null,",language":"en-GB",'
            when doc_id % 3 = 0 then '"language":5,'
            when doc_id % 3 = 1 then '"language":"",'
            else '' end as language_part,
       case when doc_id % 2 = 0 then '"model":"m1","answer":"a","score":{"x":[1,null]},' else '' end as generation_part
from documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *dealt: str) -> DataFrame:
    """Run one of the texts above over the tables of ``sf_dir``; ``dealt`` ones feed much work per row.

    The tables have names of their own for as long as the text is analysed, so that no view of the
    user's session is touched.
    """
    configure(spark)
    own = f"markscale_{uuid.uuid4().hex}_"
    names = set(re.findall(r"(?:from|join) (\w+)", sql))
    for name in names:
        frame = table(spark, sf_dir, name)
        (deal(frame) if name in dealt else frame).createTempView(own + name)
    # Both dialects quote odd column names, each with its own character.
    text = re.sub(r"\b(from|join) (\w+)", rf"\1 {own}\2", sql).replace('as ",language"', "as `,language`")
    try:
        return spark.sql(text)
    finally:
        for name in names:
            spark.catalog.dropTempView(own + name)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one JSON line with odd and missing fields: ``(doc_id, source_file, line)``."""
    parts = view(spark, sf_dir, RAW_PARTS, "documents")
    text = F.to_json(F.struct("text"))
    line = F.concat(
        F.lit('{"doc":'),
        F.col("doc_id").cast("string"),
        F.lit(","),
        "id_part",
        "language_part",
        "generation_part",
        F.substring(text, F.lit(2), F.length(text)),
    )
    return parts.select("doc_id", F.col("lang").alias("source_file"), line.alias("line"))


def judged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged answers as JSON lines in one file per language: ``(source_file, line)``.

    Only some files have the ``similarity`` key; the others carry the fallback score, and one file
    has both, with nothing but nulls under the first.
    """
    rows = view(spark, sf_dir, EVAL_ROWS)
    rows = rows.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    fields = {
        "id": F.col("id"),
        "model": F.col("model"),
        "LLMJudge result": F.col("judge"),
        "similarity": F.when(F.col("lang") == "en", F.col("sim")),
        "strict_semantic_score": F.when(F.col("lang") != "en", F.col("sim")),
    }
    text = F.to_json(F.struct(*(value.alias(name) for name, value in fields.items())))
    nulls = F.when(F.col("lang") == "de", F.lit(',"similarity":null}')).otherwise(F.lit("}"))
    return rows.select(
        "doc_id",
        F.col("lang").alias("source_file"),
        F.concat(F.substring(text, F.lit(1), F.length(text) - 1), nulls).alias("line"),
    )


def with_noise(lines: DataFrame) -> DataFrame:
    """Follow every line by a blank line and by lines that are not one JSON object."""
    noise = F.array(
        F.col("line"),
        F.lit("  "),
        F.lit("{broken"),
        F.lit("[1]"),
        F.concat(F.col("line"), F.lit(" x")),
        F.concat(F.col("line"), F.col("line")),
    )
    return lines.select("source_file", F.explode(noise).alias("line"))


def write_lines(lines: DataFrame, label: str) -> str:
    """Write ``(source_file, line)`` rows as a folder of lines and return its path."""
    path = scratch_path(lines.sparkSession, label)
    lines.select("line", "source_file").write.partitionBy("source_file").text(path)
    return path
