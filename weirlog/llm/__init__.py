"""Training-data operators: one module each, free of each other, nothing outside imports them."""
