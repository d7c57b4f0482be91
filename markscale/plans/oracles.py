"""The same answers in DuckDB SQL, written without the library's rewrites.

Similarities are averaged over explicit pairs, packing is a plain fold, and stage results are
computed from the tables without files in between.
"""

from __future__ import annotations

from markscale.plans.catalog import DIMENSIONS, PACK_LIMIT, SYSTEM
from markscale.plans.views import EVAL_ROWS, LINE_ROWS, PROMPT_ROWS, QA_ROWS, RAW_PARTS, SYSTEM_ROWS, TAGGED_ROWS

_LABEL = r"""case when judge is null or regexp_extract(judge, '\[([^\[\]]+)\]\s*$', 1) = '' then 'unknown'
     else lower(trim(regexp_extract(judge, '\[([^\[\]]+)\]\s*$', 1), e' \t\n')) end"""
_LANGUAGE = """case when substr(lower(trim(id)), 1, 2) in ('en', 'cn') then substr(lower(trim(id)), 1, 2)
     else 'unknown' end"""
_TASK = r"case when regexp_matches(trim(id), '\d\d$') then right(trim(id), 2) else 'unknown' end"
_SCORE = "case when not isnan(try_cast(sim as double)) then try_cast(sim as double) end"

_GROUPING_SETS = """grouping sets ((source_file, model), (source_file, model, language),
    (source_file, model, language, id), (source_file, model, task_type))"""


def _report(rows: str, columns: str, where: str = "true", source_file: str = "'all'") -> str:
    """The report over ``rows``, a query with id, model, judge, sim (and source_file)."""
    return f"""
with r as ({rows}),
f as (select {source_file} as source_file, model, {_LANGUAGE} as language, id, {_TASK} as task_type,
             {_LABEL} as llm_label, {_SCORE} as score
      from r where model is not null),
g as (select case when grouping(id) = 0 then 'by_model_language_id' when grouping(task_type) = 0 then 'by_model_task'
                  when grouping(language) = 0 then 'by_model_language' else 'by_model' end as "table",
             source_file, model, language, id, task_type, count(*) as n_total,
             round(avg(score), 6) as similarity_mean,
             round(case when count(score) = 1 then 0 else stddev_samp(score) / sqrt(count(score)) end, 6)
               as similarity_se,
             round(avg(case when llm_label = 'correct' then 1e0 else 0e0 end), 6) as accuracy,
             round(sqrt(avg(case when llm_label = 'correct' then 1e0 else 0e0 end)
                   * avg(case when llm_label = 'correct' then 0e0 else 1e0 end) / count(*)), 6) as accuracy_se,
             count(*) filter (llm_label = 'unknown') as n_unknown,
             round(max(score) - min(score), 6) as score_range,
             round(count(*) filter (score >= 1) / nullif(count(score), 0), 6) as high_share
      from f group by {_GROUPING_SETS})
select {columns} from g
where not ("table" = 'by_model_language_id' and id is null) and {where}
"""


_MEASURES = "n_total, similarity_mean, similarity_se, accuracy, accuracy_se"
_ALL = f'"table", model, language, id, task_type, {_MEASURES}'


def _table(name: str, keys: str) -> str:
    return _report(EVAL_ROWS, f"{keys}, {_MEASURES}", f"\"table\" = '{name}'")


# Preparation: the values of a raw row as JSON text, before and after the edits.
_ID_NOW = """case doc_id % 9 when 0 then 'null' when 1 then 'true' when 2 then '" EN_0012 "' when 3 then '12'
     when 4 then '[1,2]' when 5 then null when 6 then '1.5' when 7 then 'false'
     else concat('"d', cast(doc_id as string), '"') end"""
_ID_TEXT = """case doc_id % 9 when 0 then '"None"' when 1 then '"True"' when 2 then '"EN_0012"' when 3 then '"12"'
     when 4 then '[1,2]' when 5 then null when 6 then '"1.5"' when 7 then '"False"'
     else concat('"d', cast(doc_id as string), '"') end"""
_LANG_NOW = """case when lang = 'en' and doc_id % 2 = 0 then '" EN-US "' when lang = 'en' then '"en"'
     when lang = 'es' then 'null' when lang = 'fr' and doc_id % 3 = 0 then '5'
     when lang = 'fr' and doc_id % 3 = 1 then '""' end"""
_LANG_MOVED = f"case when lang = 'de' then '\"ZH-CN\"' else {_LANG_NOW} end"
_LANG_CASE = f"case when lang = 'en' and doc_id % 2 = 0 then '\"EN-US\"' else {_LANG_NOW} end"
_LANG_CLEAN = f"case when lang = 'en' then '\"en\"' else {_LANG_NOW} end"
_LANG_NORMAL = f"case when lang = 'de' then '\"cn\"' when lang = 'en' then '\"en\"' else {_LANG_NOW} end"
_HAS_TAG = "(lang in ('en', 'de') or (lang = 'fr' and doc_id % 3 = 1))"


def _keys(*, moved: bool = False, generation: bool = True, prompt: bool = False) -> str:
    """The key list of a raw row: after moving a lone legacy tag, after dropping the generation
    fields, or after rendering text and id into a prompt."""
    id_key = "''" if prompt else "case when doc_id % 9 = 5 then '' else 'id|' end"
    lone_tag = "''" if moved else "',language|'"
    tags = f"""case when lang = 'en' and doc_id % 2 = 0 then 'language|' when lang = 'de' then {lone_tag}
        when lang in ('en', 'es') then 'language|,language|'
        when lang = 'fr' and doc_id % 3 < 2 then 'language|' else '' end"""
    made = "model|answer|score|" if generation else "score|"
    last = "case when lang = 'de' then 'text|language' else 'text' end" if moved else "'text'"
    if prompt:
        last = "'input'"
    return f"concat('doc|', {id_key}, {tags}, case when doc_id % 2 = 0 then '{made}' else '' end, {last})"


def _prep(keys: str, id_json: str, language_json: str, where: str = "true") -> str:
    return f"""select doc_id, {keys} as key_list, {id_json} as id, {language_json} as language,
    md5(text) as text_md5 from ({RAW_PARTS}) where {where}"""


# Prompts.
_PROMPT_EMPTY = "concat('T: ', coalesce(text, ''), chr(10), 'Q: ', coalesce(question, ''), ' {end}')"
_PROMPT_NONE = "concat('T: ', coalesce(text, 'None'), chr(10), 'Q: ', coalesce(question, 'None'), ' {end}')"
_JUDGE_PROMPT = """concat('Q: ', coalesce(question, ''), chr(10), 'A: ', coalesce(answer, ''), chr(10), 'R: ',
    coalesce(reference, ''), chr(10), 'Verdict:')"""
_ID_IN_PROMPT = f"case when doc_id % 9 = 5 then '' when doc_id % 9 = 2 then ' EN_0012 ' else trim({_ID_TEXT}, '\"') end"

# Similarity: letter counts of every sentence, and the mean cosine over all pairs of sentences.
_CHUNKS = """list_transform(list_filter(string_split({0}, '.'), lambda s: trim(s, e' \\t\\n\\r') <> ''),
    lambda s: concat(s, '.'))"""


def _letters(chunk: str) -> str:
    return f"""list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''),
        lambda l: cast(length({chunk}) - length(replace({chunk}, l, '')) as double))"""


# The same sentences packed into chunks, as one expression.
_FOLDED = f"""list_reduce(list_transform({_CHUNKS}, lambda p: {{{{'done': cast([] as varchar[]), 'open': p,
    'units': cast(length(p) as bigint)}}}}), lambda acc, x: case when acc.units + x.units <= {PACK_LIMIT}
        then {{{{'done': acc.done, 'open': concat(acc.open, x.open), 'units': acc.units + x.units}}}}
        else {{{{'done': case when acc.open = '' then acc.done else list_append(acc.done, acc.open) end, 'open': x.open,
              'units': x.units}}}} end,
    {{{{'done': cast([] as varchar[]), 'open': '', 'units': cast(0 as bigint)}}}})"""
_PACKED_CHUNKS = f"""case when coalesce({{0}}, '') = '' then [] when length({{0}}) <= {PACK_LIMIT} then [{{0}}]
    when {_FOLDED}.open = '' then {_FOLDED}.done else list_append({_FOLDED}.done, {_FOLDED}.open) end"""


def _pair_mean(rows: str, keys: str, chunks: str = _CHUNKS) -> str:
    """Mean pairwise cosine of the sentences of answer and reference, for every row of ``rows``."""
    return f"""
(with q as ({rows}),
 a as (select {keys}, unnest({chunks.format("answer")}) as c from q),
 b as (select {keys}, unnest({chunks.format("reference")}) as c from q),
 va as (select {keys}, {_letters("c")} as v from a),
 vb as (select {keys}, {_letters("c")} as v from b)
 select {keys}, avg(coalesce(nullif(list_cosine_similarity(va.v, vb.v), 'nan'::double), 0)) as similarity
 from va join vb using ({keys}) group by {keys})
"""


_SIMILARITY = f"""
select q.conv_id, q.turn, round(similarity, 6) as similarity
from ({QA_ROWS}) q left join {_pair_mean(QA_ROWS, "conv_id, turn")} s on s.conv_id = q.conv_id and s.turn = q.turn
"""

_SIMILARITY_PACKED = f"""
select q.conv_id, q.turn, round(similarity, 6) as similarity
from ({QA_ROWS}) q
left join {_pair_mean(QA_ROWS, "conv_id, turn", _PACKED_CHUNKS)} s on s.conv_id = q.conv_id and s.turn = q.turn
"""

_COSINE = f"""
with v as (select vec_id // 10 as g, vec_id % 2 as side, embedding::float[{DIMENSIONS}] as e from embeddings)
select a.g, round(avg(array_cosine_similarity(a.e::double[{DIMENSIONS}], b.e::double[{DIMENSIONS}])), 6) as similarity
from v a join v b on a.g = b.g and a.side = 0 and b.side = 1 group by a.g
"""

_PACKED = f"""
with s as (select doc_id, text, {_CHUNKS.format("text")} as parts from documents),
st as (select doc_id, text, list_transform(parts, lambda p:
         {{'done': cast([] as varchar[]), 'open': p, 'units': cast(length(p) as bigint)}}) as steps from s),
fo as (select doc_id, text, list_reduce(steps, lambda acc, x:
         case when acc.units + x.units <= {PACK_LIMIT}
              then {{'done': acc.done, 'open': concat(acc.open, x.open), 'units': acc.units + x.units}}
              else {{'done': case when acc.open = '' then acc.done else list_append(acc.done, acc.open) end,
                    'open': x.open, 'units': x.units}} end,
         {{'done': cast([] as varchar[]), 'open': '', 'units': cast(0 as bigint)}}) as f from st),
c as (select doc_id, case when length(text) <= {PACK_LIMIT} then [text]
             when f.open = '' then f.done else list_append(f.done, f.open) end as c from fo)
select doc_id, cast(len(c) as bigint) as n_chunks, md5(array_to_string(c, '|')) as chunks_md5 from c
"""

# Model stand-ins: what the endpoints answer to a prompt.
_ANSWERED = f"select *, {_PROMPT_NONE} as prompt from (select conv_id, turn, reference as text, question from ({QA_ROWS}))"
_COUNT_E = "(length(prompt) - length(replace(prompt, 'e', '')))"
_JUDGED = f"select *, {_JUDGE_PROMPT} as prompt from ({QA_ROWS})"
_VERDICT = f"case when {_COUNT_E} % 7 = 2 then '[Corr' when {_COUNT_E} % 2 = 0 then '[Correct]' else '[Incorrect]' end"

# Files: the judged answers by language; English rows have scores under the first key, the German
# file has nothing but nulls under it, and the other files fall back to the second key.
_JUDGED_FILES = f"select e.*, d.lang from ({EVAL_ROWS}) e join documents d on d.doc_id = e.doc_id"
_FOLDER_ROWS = f"select id, model, judge, case when lang <> 'de' then sim end as sim, lang from ({_JUDGED_FILES})"
_FOLDER = _report(_FOLDER_ROWS, f'source_file, {_ALL}', source_file="lang")
_PLAIN = _report(
    f"select id, model, judge, case when lang <> 'de' then sim end as sim, lang, doc_id from ({_JUDGED_FILES})",
    f"source_file, {_ALL}", source_file="concat(lang, '_', doc_id // 1000000)",
)

_CHAIN_QA = f"""
select conv_id, turn, question, reference,
       concat(case when conv_id % 2 = 0 then 'EN_' else 'cn_' end, lpad(cast(turn % 100 as string), 2, '0')) as id,
       replace(coalesce(question, 'None'), 'e', 'a') as answer
from ({QA_ROWS})
where not contains(concat('S: ', reference, chr(10), 'Q: ', coalesce(question, 'None')), 'onth')
"""
_CHAIN_LOST = f"""
select 'infer' as stage, concat(case when conv_id % 2 = 0 then 'EN_' else 'cn_' end, lpad(cast(turn % 100 as string), 2, '0')) as id,
       md5(question) as question, null as answer, md5(reference) as reference
from ({QA_ROWS})
where contains(concat('S: ', reference, chr(10), 'Q: ', coalesce(question, 'None')), 'onth')
"""
_CHAIN_PROMPT = """concat('Q: ', coalesce(question, 'None'), chr(10), 'A: ', answer, chr(10), 'R: ', reference, chr(10),
    'Verdict:')"""
_CHAIN_ROWS = f"""
select id, 'stub-1' as model, {_VERDICT} as judge, similarity as sim
from (select q.*, {_CHAIN_PROMPT} as prompt, s.similarity from ({_CHAIN_QA}) q
      left join {_pair_mean(_CHAIN_QA, "conv_id, turn")} s on s.conv_id = q.conv_id and s.turn = q.turn)
where {_COUNT_E} % 7 not in (0, 1)
"""

_CHAIN_FAILED = f"""
{_CHAIN_LOST} union all
select 'judge' as stage, id, md5(question) as question, md5(answer) as answer, md5(reference) as reference
from (select *, {_CHAIN_PROMPT} as prompt from ({_CHAIN_QA})) where {_COUNT_E} % 7 in (0, 1)
"""

ORACLES: dict[str, str] = {
    "report_by_model": _table("by_model", "model"),
    "report_by_model_language": _table("by_model_language", "model, language"),
    "report_by_model_language_id": _table("by_model_language_id", "model, language, id"),
    "report_by_model_task": _table("by_model_task", "model, task_type"),
    "report_all": _report(EVAL_ROWS, _ALL),
    "report_all_lineitem": _report(LINE_ROWS, _ALL),
    "report_own_measures": _report(EVAL_ROWS, f"{_ALL}, score_range, high_share"),
    "report_unknown_verdicts": _report(EVAL_ROWS, "model, n_total, n_unknown", "\"table\" = 'by_model'"),
    "verdict_label": f"select doc_id, {_LABEL} as llm_label from ({EVAL_ROWS})",
    "correct_flag": f"select doc_id, {_LABEL} = 'correct' as is_correct from ({EVAL_ROWS})",
    "language_from_id": f"select doc_id, {_LANGUAGE} as language from ({EVAL_ROWS})",
    "task_from_id": f"select doc_id, {_TASK} as task_type from ({EVAL_ROWS})",
    "score_coerce": f"select doc_id, round({_SCORE}, 6) as score from ({EVAL_ROWS})",
    "drop_generation_fields": _prep(_keys(generation=False), _ID_NOW, _LANG_NOW),
    "legacy_language": _prep(_keys(moved=True), _ID_NOW, _LANG_MOVED),
    "language_canonical": _prep(_keys(), _ID_NOW, _LANG_CLEAN),
    "language_canonical_case_kept": _prep(_keys(), _ID_NOW, _LANG_CASE),
    "id_normalize": _prep(_keys(), _ID_TEXT, _LANG_NOW),
    "drop_missing_language": _prep(_keys(), _ID_NOW, _LANG_NOW, _HAS_TAG),
    "normalize_dataset": _prep(_keys(moved=True), _ID_TEXT, _LANG_NORMAL, _HAS_TAG),
    "normalize_columns": f"""select doc_id, trim(id) as id, md5(text) as text,
        case when language = ' EN-US' then 'en' when language is null then 'cn' else language end as language
        from ({TAGGED_ROWS}) where language is not null or ",language" is not null""",
    "prompt_render": f"select doc_id, md5({_PROMPT_EMPTY}) as input from ({PROMPT_ROWS})",
    "prompt_render_keep": f"select doc_id, md5(text) as text, md5({_PROMPT_EMPTY}) as question from ({PROMPT_ROWS})",
    "prompt_render_records": f"""select doc_id, {_keys(prompt=True)} as key_list,
        md5(concat('T: ', text, chr(10), 'Q: ', case when doc_id % 9 = 4 then '[1, 2]' else {_ID_IN_PROMPT} end,
        ' {{end}}')) as input from ({RAW_PARTS})""",
    "answer_prompt": f"select doc_id, md5({_PROMPT_NONE}) as prompt from ({PROMPT_ROWS})",
    "judge_prompt": f"select conv_id, turn, md5({_JUDGE_PROMPT}) as prompt from ({QA_ROWS})",
    "chat_messages": f"""select * from (select conv_id, turn, 'system' as role, coalesce(instruction, '{SYSTEM}') as content
        from ({SYSTEM_ROWS})) where content <> ''
        union all select conv_id, turn, 'user', question from ({QA_ROWS})""",
    "chunk_sentences": f"""select doc_id, cast(len(c) as bigint) as n_chunks, md5(array_to_string(c, '|')) as chunks_md5
        from (select doc_id, {_CHUNKS.format("text")} as c from documents)""",
    "chunk_packed": _PACKED,
    "cosine_matrix_mean": _COSINE,
    "similarity_score": _SIMILARITY,
    "similarity_score_distinct": _SIMILARITY,
    "similarity_score_packed": _SIMILARITY_PACKED,
    "similarity_score_distinct_packed": _SIMILARITY_PACKED,
    "batch_completion_ok": f"""select conv_id, turn, md5(text) as text, question,
        case when not contains(prompt, 'quer') then concat('stub-1 2 ', md5(prompt)) end as answer, 'stub-1' as model
        from ({_ANSWERED}) where not contains(prompt, 'onth')""",
    "batch_completion_failed": f"""select conv_id, turn, md5(text) as text, question
        from ({_ANSWERED}) where contains(prompt, 'onth')""",
    "batch_completion_ledger": f"""select conv_id, turn,
        case when not contains(prompt, 'quer') and not contains(prompt, 'onth') then concat('stub-1 2 ', md5(prompt)) end as answer,
        contains(prompt, 'onth') as failed from ({_ANSWERED})""",
    "judge_ok": f"""select conv_id, turn, md5(question) as question, md5(answer) as answer, md5(reference) as reference,
        {_VERDICT} as judge_raw from ({_JUDGED}) where {_COUNT_E} % 7 not in (0, 1)""",
    "judge_failed": f"""select conv_id, turn, md5(question) as question, md5(answer) as answer,
        md5(reference) as reference from ({_JUDGED}) where {_COUNT_E} % 7 in (0, 1)""",
    "jsonl_strict": f"""select concat('processed_', lang) as source_file, doc_id, {_keys()} as key_list,
        md5(text) as text_md5 from ({RAW_PARTS})""",
    "jsonl_lenient": f"""select lang as source_file, id, model, judge,
        coalesce(lang = 'de' or (lang = 'en' and sim is not null), false) as has_similarity,
        case when lang = 'en' then sim end as sim, case when lang <> 'en' then sim end as fallback
        from ({_JUDGED_FILES})""",
    "folder_report": _FOLDER,
    "plain_folder_report": f"""select * from ({_PLAIN}) union all
        select {", ".join(f"'nothing' as {c}" if c == "source_file" else f"'no rows' as {c}" if c == '"table"' else f"null as {c}"
                          for c in f"source_file, {_ALL}".split(", "))}""",
    "csv_report": f"""select concat(source_file, '_', "table") as source_file, "table", model, language, id, task_type,
        concat(n_total, '.0') as n_total, similarity_mean, similarity_se, accuracy, accuracy_se
        from ({_FOLDER})""",
    "csv_order": f"""select concat(source_file, '_', "table") as source_file, "table", model, language, id, task_type,
        row_number() over (partition by source_file, "table"
            order by model, language nulls first, id nulls first, task_type nulls first) as place
        from ({_FOLDER})""",
    "evaluation_failed": _CHAIN_FAILED,
    "evaluation_end_to_end": _report(
        _CHAIN_ROWS, f"source_file, {_ALL}", source_file="'llmjudge_processed_answers'"
    ),
}
