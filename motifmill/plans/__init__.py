"""Driver-side planning: shipping code, written intermediates, iteration control."""
