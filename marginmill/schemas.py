"""Logical tables and the columns the operators touch; other columns are carried along."""

COLUMNS = {
    "order_items": {"order_id": "string", "product_id": "string", "price": "double"},
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_purchase_timestamp": "timestamp_ntz",
    },
    "customers": {"customer_id": "string", "customer_unique_id": "string"},
    "products": {"product_id": "string", "product_category_name": "string"},
    "payments": {"order_id": "string", "payment_value": "double"},
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
    "campaigns": {
        "campaign_id": "string",
        "campaign_name": "string",
        "channel": "string",
        "discount_pct": "int",
        "budget": "int",
    },
    "product_costs": {"product_id": "string", "cost_price": "double"},
    "campaign_sales_mapping": {"order_id": "string", "campaign_id": "string"},
    "customer_segments": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_segment": "string",
    },
    "sales_features": {
        "order_id": "string",
        "product_id": "string",
        "price": "double",
        "cost_price": "double",
        "revenue": "double",
        "gross_profit": "double",
        "profit_margin_pct": "double",
    },
}

RAW_TABLES = ["customers", "orders", "products", "order_items", "payments"]
