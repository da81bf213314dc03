"""Sources and sinks: markdown folders, index documents, model servers."""
