"""Training-data operators on documents and web pages; nothing else imports this package."""
