"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from storyloom.llm import decontaminate, divergence, language, language_model, line_dedup, nearest, packing, quality, search, simhash, token_files, tool_calls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_language_model": language_model.op2_language_model,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_packing": packing.op5_packing,
    "op6_language": language.op6_language,
    "op7_nearest": nearest.op7_nearest,
    "op8_tool_calls": tool_calls.op8_tool_calls,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_token_files": token_files.op11_token_files,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL = {
    "op1_warc": warc.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op8_tool_calls": tool_calls.OP8_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op12_ranked_search": search.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
