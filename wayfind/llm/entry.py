"""The queries of this subpackage, and SQL for those that SQL can express."""

from wayfind.llm.byte_bpe import op8_byte_bpe
from wayfind.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from wayfind.llm.decontaminate import OP3_SQL, op3_decontaminate
from wayfind.llm.html_extraction import op12_html_extraction
from wayfind.llm.license_scan import op1_license_scan
from wayfind.llm.lm_scoring import op5_lm_scoring
from wayfind.llm.paragraph_dedup import op9_paragraph_dedup
from wayfind.llm.periodic_runs import OP13_SQL, op13_periodic_runs
from wayfind.llm.quality_rules import OP4_SQL, op4_quality_rules
from wayfind.llm.simhash_dedup import op7_simhash_near_dedup
from wayfind.llm.suffix_dedup import OP10_SQL, op10_suffix_dedup
from wayfind.llm.token_counts import OP2_SQL, op2_token_counts
from wayfind.llm.warc import OP6_SQL, op6_warc

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_decontaminate, op4_quality_rules, op5_lm_scoring, op6_warc, op7_simhash_near_dedup, op8_byte_bpe, op9_paragraph_dedup, op10_suffix_dedup, op11_conversation_repair, op12_html_extraction, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op2_token_counts": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_quality_rules": OP4_SQL, "op6_warc": OP6_SQL, "op10_suffix_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op13_periodic_runs": OP13_SQL}
