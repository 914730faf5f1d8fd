"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from segspark.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from segspark.llm.decontamination import op5_decontamination
from segspark.llm.license_scan import op2_license_scan
from segspark.llm.line_dedup import OP12_SQL, op12_line_dedup
from segspark.llm.mixing import OP9_SQL, op9_mixing
from segspark.llm.ngram_join import OP4_SQL, op4_ngram_join
from segspark.llm.quality_mil import op3_quality_classifier
from segspark.llm.quality_rules import OP10_SQL, op10_quality_rules
from segspark.llm.secret_scan import op7_secret_scan
from segspark.llm.target_resampling import OP13_SQL, op13_target_resampling
from segspark.llm.token_counts import op8_token_counts
from segspark.llm.url_filter import OP1_SQL, op1_url_filter
from segspark.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op6_warc": op6_warc,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontamination": op5_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_target_resampling": op13_target_resampling,
}

ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op4_ngram_join": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op9_mixing": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_target_resampling": OP13_SQL,
}
