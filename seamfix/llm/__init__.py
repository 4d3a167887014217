"""Training-data operators; ``queries`` registers them, nothing else imports this package."""
