"""The operators' queries and SQL, by name."""

from __future__ import annotations

from . import chat, decontaminate, html, licenses, mixing, quality, secrets, simhash, spotsigs, substrings

QUERIES = {
    "op1_quality_gam": quality.op1_query,
    "op2_license_dice": licenses.op2_query,
    "op3_html_blocks": html.op3_query,
    "op4_simhash_pivots": simhash.op4_query,
    "op5_temperature_mix": mixing.op5_query,
    "op6_secret_ledger": secrets.op6_query,
    "op7_spotsigs": spotsigs.op7_query,
    "op8_wu_manber": decontaminate.op8_query,
    "op9_longest_previous_factor": substrings.op9_query,
    "op10_chat_windows": chat.op10_query,
    "secret_ledger_rescan": secrets.rescan_query,
}

ORACLE_SQL = {
    "op2_license_dice": licenses.OP2_SQL,
    "op3_html_blocks": html.OP3_SQL,
    "op6_secret_ledger": secrets.OP6_SQL,
    "op8_wu_manber": decontaminate.OP8_SQL,
    "op10_chat_windows": chat.OP10_SQL,
    "secret_ledger_rescan": secrets.RESCAN_SQL,
}
