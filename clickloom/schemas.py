"""Table schemas as Spark types. Unix seconds are longs; money is DECIMAL(10,2)."""

from __future__ import annotations

SCHEMAS = {
    "logs": (
        "id bigint, ts bigint, ip string, ua string, click_id string, country_code string, user_lp string, "
        "decision string"
    ),
    "postback_received": (
        "id bigint, ts bigint, status string, country_code string, traffic_type string, payout decimal(10,2), "
        "click_id string, network string, signature_verified boolean, ip_address string, query_string string"
    ),
    "postback_logs": (
        "id bigint, ts bigint, country_code string, traffic_type string, payout decimal(10,2), postback_url string, "
        "response_code int, response_body string, success boolean"
    ),
    "clicks": (
        "id bigint, click_id string, ts bigint, country_code string, user_agent string, device_type string, "
        "ip_address string, referrer string, user_lp string, redirect_url string, final_url string, status string, "
        "postback_status string, postback_payout decimal(10,2), postback_ts bigint, created_at bigint"
    ),
    "settings": (
        "id int, system_on boolean, redirect_url string, country_filter_mode string, country_filter_list string, "
        "postback_enabled boolean, postback_url string, default_payout decimal(10,2), total_decision_a bigint, "
        "total_decision_b bigint, stats_reset_at bigint, updated_at bigint"
    ),
    "routing_rules": (
        "id int, rule_name string, country_code string, device_type string, user_lp string, redirect_url string, "
        "priority int, is_active boolean, created_at bigint, updated_at bigint"
    ),
    "env_config": (
        "id int, config_key string, config_value string, config_type string, description string, "
        "is_sensitive boolean, is_editable boolean, updated_at bigint, updated_by int"
    ),
    "api_rate_limit": "ip_address string, requests bigint, window_start bigint",
    "rate_limit_tracking": (
        "id bigint, ip string, endpoint string, attempts bigint, window_start bigint, window_end bigint, "
        "blocked_until bigint"
    ),
    "postback_security_log": "id bigint, ts bigint, ip string, success boolean, message string, data string",
    "failed_login_attempts": (
        "id bigint, ip string, username string, user_agent string, attempted_at bigint, reason string"
    ),
    "audit_log": (
        "id bigint, user_id int, action string, entity_type string, entity_id int, ip_address string, "
        "user_agent string, details string, created_at bigint"
    ),
    "users": "id int, username string, email string, is_active boolean, last_login_at bigint, created_at bigint",
}

# The decision log under its older name.
SCHEMAS["traffic_logs"] = SCHEMAS["logs"]


def schema_of(name: str) -> list[str]:
    """Columns of a table in their declared order."""
    return [part.split()[0] for part in SCHEMAS[name].replace("decimal(10,2)", "decimal").split(", ")]


# Older column names of the decision log.
TRAFFIC_LOG_NAMES = {"cid": "click_id", "cc": "country_code", "lp": "user_lp"}

# Keys that must be unique.
UNIQUE_KEYS = {
    "clicks": ["click_id"],
    "env_config": ["config_key"],
    "rate_limit_tracking": ["ip", "endpoint", "window_start"],
    "users": ["username"],
}
