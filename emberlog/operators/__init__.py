"""Questions that are asked of records: filters, summaries, navigation, drill-down, analyst state, export."""
