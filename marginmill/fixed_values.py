"""Values that are part of the results and therefore fixed: tables, labels, word lists, factors."""

# The campaigns (id, name, channel, discount %, budget).
CAMPAIGNS = [
    ("C001", "New Year Sale", "Email", 10, 5000),
    ("C002", "Summer Sale", "Google Ads", 15, 8000),
    ("C003", "Festival Sale", "Social Media", 20, 12000),
    ("C004", "Flash Sale", "Influencer", 25, 10000),
    ("C005", "Weekend Bonanza", "SMS", 5, 3000),
]
CAMPAIGN_IDS = [row[0] for row in CAMPAIGNS]

# Product cost as a share of the mean price, lowest share and width of the range.
COST_SHARE_LOW = 0.50
COST_SHARE_WIDTH = 0.35

# Customer segments by mean item spend, and the label below all of them.
SEGMENT_THRESHOLDS = [
    (170.0, "Premium"),
    (100.0, "High Value"),
    (50.0, "Regular"),
]
LOWEST_SEGMENT = "Occasional"

# Plain-language names of the segments.
SEGMENT_NAMES = {
    "Premium": "Big Spenders",
    "High Value": "Frequent Shoppers",
    "Regular": "Normal Shoppers",
    "Occasional": "Rare Shoppers",
}
ALL_CUSTOMERS = "All Customers"

# The category given to products without one, and the two margin limits of the advice.
UNKNOWN = "unknown"
LOW_MARGIN_PCT = 20
HIGH_MARGIN_PCT = 40

# Recommendations of the strict benchmark rule.
GROW = "Increase promotion budget"
FIX_MARGIN = "Reduce discounts and improve margins"
REVIEW = "Review category strategy"
TEST = "Test targeted promotions"

# Labels and texts of the strategy advice.
ADS = "🚀 Pay for more ads (Very Profitable)"
FEWER_DISCOUNTS = "⚠️ Give fewer discounts (Losing money on discounts)"
STOP = "🛑 Stop/Review this category (Not selling well)"
SMALL_DISCOUNTS = "🎯 Give small discounts to specific customers"
ACTION_STEPS = {
    ADS: (
        "This item sells in high volumes and keeps a good profit. "
        "Spend more on ads to get more customers!"
    ),
    FEWER_DISCOUNTS: (
        "You sell a lot of these items, but make very little profit because you give too many "
        "discounts. Raise the price or stop discounts!"
    ),
    STOP: (
        "These items are not selling well and do not bring in profit. "
        "Review buying costs or stop selling them."
    ),
    SMALL_DISCOUNTS: (
        "These items have high profit margins but low sales volume. "
        "Offer small discounts to Big Spenders to get them to buy more."
    ),
}

# Forecast factors and the scenario ranges.
VOLUME_FACTORS = {5: 1.0, 10: 1.25, 15: 1.15, 20: 0.95, 25: 1.40}
DEFAULT_VOLUME_FACTOR = 1.0
BUDGET_EFFECT = 0.25
BUDGET_FLOOR = 1000
BUDGET_SCALE = 4000.0
REACH = 0.05
DISCOUNTS = [5, 10, 15, 20, 25]
BUDGETS = range(1000, 30001, 1000)
DEFAULT_BUDGET = 8000

# Words that give a question its intent; the first intent with a hit wins.
INTENT_WORDS = [
    ("discount", ["discount", "offer", "percent", "sweet spot"]),
    ("campaign", ["campaign", "roi", "marketing", "channel"]),
    ("segment", ["customer", "segment", "premium", "high value", "regular"]),
    ("category", ["category", "categories", "product", "products"]),
]
SQL_WORDS = ["select", "from"]

# Plain-language wording, applied in this order.
GLOSSARY = [
    ("Offline Pricing & Discount Analysis", "Simple Discount Analysis"),
    ("Offline Campaign Performance & ROI Diagnostics", "Simple Advertisement Worth Analysis"),
    ("Offline Customer Segment Performance Analysis", "Simple Customer Types Analysis"),
    ("Offline Category Profitability Analysis", "Simple Product Types Analysis"),
    ("gross profit", "actual profit"),
    ("ROI (%)", "Worth / ROI %"),
    ("customer_segment", "customer type"),
    ("revenue", "sales"),
    ("Premium", "Big Spenders"),
    ("High Value", "Frequent Shoppers"),
    ("Regular", "Normal Shoppers"),
    ("Occasional", "Rare Shoppers"),
]

# Text around a SQL question that is not SQL.
CODE_FENCES = ["```sql", "```"]
