"""The queries of this subpackage by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from mediaweave.llm.chat import OP10_SQL, op10_chat
from mediaweave.llm.decontam import OP7_SQL, op7_decontamination
from mediaweave.llm.exact import OP2_SQL, op2_exact_dedup
from mediaweave.llm.html_text import op4_html_text
from mediaweave.llm.langid import op6_language_id
from mediaweave.llm.licenses import op8_license_scan
from mediaweave.llm.minhash import OP13_SQL, op13_minhash
from mediaweave.llm.mixing import OP1_SQL, op1_mix_sources
from mediaweave.llm.repair import OP12_SQL, op12_repair
from mediaweave.llm.secret_scan import op5_secret_scan
from mediaweave.llm.simhash import op3_simhash
from mediaweave.llm.suffix import op9_suffix_dedup
from mediaweave.llm.variants import OP11_SQL, op11_spelling

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash": op3_simhash,
    "op4_html_text": op4_html_text,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat": op10_chat,
    "op11_spelling": op11_spelling,
    "op12_repair": op12_repair,
    "op13_minhash": op13_minhash,
}
ORACLES = {"op1_mix_sources": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op7_decontamination": OP7_SQL, "op10_chat": OP10_SQL, "op11_spelling": OP11_SQL, "op12_repair": OP12_SQL, "op13_minhash": OP13_SQL}
