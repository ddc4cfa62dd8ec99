"""The one rule that suits a stream: sensor usability at an explicit instant."""
