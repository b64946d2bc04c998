"""DataFrame -> DataFrame operators over the quality fact."""
