"""Tables, dimensions, label fixtures, images, sinks."""
