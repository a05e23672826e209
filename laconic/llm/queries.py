"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from laconic.llm.decontaminate import ORACLE as OP10, op10_decontaminate
from laconic.llm.langid import op6_language_id
from laconic.llm.licenses import ORACLE as OP4, op4_licenses
from laconic.llm.packing import op7_packing
from laconic.llm.passages import op8_passages
from laconic.llm.pii import op9_personal_data
from laconic.llm.quality import op3_quality
from laconic.llm.simhash import op2_near_duplicates
from laconic.llm.token_store import op1_token_store
from laconic.llm.urls import op5_url_filter

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_passages": op8_passages,
    "op9_personal_data": op9_personal_data,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES = {"op4_licenses": OP4, "op10_decontaminate": OP10}
