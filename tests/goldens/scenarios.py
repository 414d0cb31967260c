"""Published what-if inputs and results: (parameter, value, scenario total, change %)."""

SPECS = [
    {"scenario_type": "pricing", "title": "价格", "parameters": {
        "price_change_range": [-15, -10, -5, 5, 10, 15],
        "profit_margin_threshold": 0.42, "sales_volume_change_threshold": 0.1}},
    {"scenario_type": "allocation", "title": "库存", "parameters": {
        "promotion_budget_allocation": [0.2, 0.3, 0.5, 0.7],
        "inventory_adjustment_factor": [0.8, 1.0, 1.2, 1.5], "category_focus_threshold": 0.75}},
    {"scenario_type": "risk", "title": "风险", "parameters": {
        "cost_increase_scenarios": [5, 10, 15, 20],
        "sales_volume_decline_scenarios": [-5, -10, -15], "profit_margin_alert_threshold": 0.39}},
    {"scenario_type": "operations", "title": "运营", "parameters": {
        "customer_rating_segments": [4.2, 4.3, 4.5, 4.7, 4.8],
        "regional_performance_variation": [0.95, 1.0, 1.05], "targeted_investment_increment": [5, 10, 15]}},
]

TOTALS = [
    30338611.68, 30338611.68, 30338611.68, 30338611.68, 30338611.68, 30338611.68, 30338612.56, 30338611.68,
    30399288.91, 30429627.52, 30490304.74, 30550981.97, 30581320.58, 30641997.80, 30702675.02, 30793690.86, 30338613.37,
    30338611.68, 30338611.68, 30338611.68, 30338611.68, 28821681.10, 27304750.52, 25787819.93, 30338612.22,
    31612833.37, 31643171.99, 31703849.21, 31764526.43, 31794865.04, 30626828.49, 30641997.80, 30657167.11,
    31855542.27, 33372472.85, 34889403.44,
]

CHANGES_PCT = [
    42.17, 42.17, 42.17, 42.17, 42.17, 42.17, 42.17, 42.17, 42.46, 42.60, 42.89, 43.17, 43.31, 43.60, 43.88, 44.31, 42.17,
    42.17, 42.17, 42.17, 42.17, 35.07, 27.96, 20.85, 42.17, 48.15, 48.29, 48.57, 48.86, 49.00, 43.53, 43.60, 43.67,
    49.28, 56.39, 63.50,
]
