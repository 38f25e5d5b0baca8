"""DataFrame to DataFrame operators over the source's relations."""
