"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from boardsift.llm.chat_format import OP8_SQL, op8
from boardsift.llm.decontaminate import OP1_SQL, op1
from boardsift.llm.embeddings import op5
from boardsift.llm.jaccard import op4
from boardsift.llm.language import op3
from boardsift.llm.quality import op10
from boardsift.llm.suffixes import op2
from boardsift.llm.token_files import op9
from boardsift.llm.tokens import op6, op7

QUERIES = {
    "op1_decontaminate": op1,
    "op2_suffix_dedup": op2,
    "op3_language": op3,
    "op4_jaccard_join": op4,
    "op5_embedding_dedup": op5,
    "op6_bpe_codec": op6,
    "op7_token_count": op7,
    "op8_chat_format": op8,
    "op9_token_files": op9,
    "op10_quality": op10,
}

ORACLE_SQL = {"op1_decontaminate": OP1_SQL, "op8_chat_format": OP8_SQL}
