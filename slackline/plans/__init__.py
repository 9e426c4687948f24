"""How plans are built: derived inputs, iteration with durable state."""
